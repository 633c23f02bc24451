"""Checks of label rows, manifests and splits."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import yolo_to_pixels
from ..functions.scalars import is_absolute_path, parse_strict_int
from ..schemas import SPLITS


def _outside(value: Column) -> Column:
    return F.isnan(value) | (F.abs(value) == float("inf")) | ~value.between(0.0, 1.0)


#: What label_row_errors reads of a row.
LABEL_ROW_COLUMNS = ("image_id", "line_no", "n_values", "class_id", "xc", "yc", "w", "h", "width", "height")


def label_row_errors(rows: DataFrame) -> DataFrame:
    """rows(image_id, line_no, n_values, class_id, xc, yc, w, h, width, height) with errors, an array in code order, and
    is_box: rows without five numbers are no box, later errors keep it."""
    five = F.col("n_values") == 5
    numeric = F.col("class_id").isNotNull() & F.col("xc").isNotNull() & F.col("yc").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    px = yolo_to_pixels(F.col("xc"), F.col("yc"), F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    x0, y0, x1, y1 = (px[c] for c in ("xmin", "ymin", "xmax", "ymax"))
    line = F.col("line_no").cast("string")
    say = lambda before, after="": F.concat(F.lit(before), line, F.lit(after))
    is_box = five & numeric
    off = (x0 < 0) | (y0 < 0) | (x1 > F.col("width")) | (y1 > F.col("height")) | (x1 <= x0) | (y1 <= y0)
    errors = F.array_compact(
        F.array(
            F.when(~five, say("label_line_", "_does_not_have_five_values")),
            F.when(five & ~numeric, say("label_line_", "_has_non_numeric_values")),
            F.when(is_box & (F.col("class_id") != 0), say("invalid_class_id_line_")),
            F.when(is_box & (_outside(F.col("xc")) | _outside(F.col("yc")) | _outside(F.col("w")) | _outside(F.col("h"))), say("invalid_normalized_coordinate_line_")),
            F.when(is_box & ((F.col("w") <= 0) | (F.col("h") <= 0)), say("non_positive_box_size_line_")),
            F.when(is_box & off, say("reconstructed_box_outside_image_line_")),
        )
    )
    return rows.withColumn("errors", errors).withColumn("is_box", is_box)


def label_errors(rows: DataFrame) -> DataFrame:
    """(image_id, line_no, error)."""
    return label_row_errors(rows).select("image_id", "line_no", F.explode("errors").alias("error"))


def dimension_conflicts(images: DataFrame) -> DataFrame:
    """images(image_id, and width and height with prefixes src_, xml_, conv_) → (image_id, conflict)."""
    differ = lambda a, b: (F.col(a + "width") != F.col(b + "width")) | (F.col(a + "height") != F.col(b + "height"))
    found = F.array_compact(F.array(F.when(differ("src_", "conv_"), "source_and_converted_dimensions_conflict"), F.when(differ("src_", "xml_"), "source_image_and_xml_dimensions_conflict"), F.when(differ("xml_", "conv_"), "source_xml_and_converted_dimensions_conflict")))
    return images.select("image_id", F.explode(found).alias("conflict"))


def missing_parts(images: DataFrame) -> DataFrame:
    """images(image_id, has_xml, has_source, has_converted, has_label) → (image_id, part)."""
    parts = {"has_xml": "missing_source_xml", "has_source": "missing_source_image", "has_converted": "missing_converted_image", "has_label": "missing_converted_label"}
    return images.select("image_id", F.explode(F.array_compact(F.array(*[F.when(~F.col(c), name) for c, name in parts.items()]))).alias("part"))


def invalid_split_values(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("split").isNull() | ~F.col("split").isin(*SPLITS)).select("image_id", "split")


def non_integer_metadata(manifest: DataFrame) -> DataFrame:
    """Manifest rows whose object_count or small_box_count text is no whole number."""
    return manifest.where(parse_strict_int(F.col("object_count")).isNull() | parse_strict_int(F.col("small_box_count")).isNull()).select("image_id", "object_count", "small_box_count")


def absolute_manifest_paths(manifest: DataFrame, fields: tuple = ("image_path", "label_path", "source_image_path", "source_xml_path")) -> DataFrame:
    """(image_id, field, value) of absolute paths."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return manifest.select("image_id", F.explode(pairs).alias("p")).select("image_id", "p.field", "p.value").where(is_absolute_path(F.col("value")))


#: What may not stand before a machine-dependent path, its roots, and what it goes on with.
MACHINE_PATH = r"""(?<![A-Za-z0-9_.-])(?:/(?:Users|home|private|tmp|var|opt|mnt)/[^\s"']*|[A-Za-z]:\\[^\s"']*)"""


def scan_absolute_paths(files: DataFrame, path: str = "path", content: str = "content", pattern: str = MACHINE_PATH) -> DataFrame:
    """files(path, content bytes) → (path, line_no, detail): lines with a machine path, the first of each, and files that are
    not UTF-8."""
    text = F.col(content).cast("string")
    good = F.is_valid_utf8(text)
    bad = files.where(~good).select(F.col(path).alias("path"), F.lit(0).alias("line_no"), F.lit("not UTF-8").alias("detail"))
    lines = files.where(good).select(F.col(path).alias("path"), F.posexplode(F.split(text, r"\R")).alias("p", "line"))
    return lines.where(F.col("line").rlike(pattern)).select("path", (F.col("p") + 1).alias("line_no"), F.regexp_extract("line", pattern, 0).alias("detail")).unionByName(bad)


def scan_path_lines(lines: DataFrame, pattern: str = MACHINE_PATH) -> DataFrame:
    """scan_absolute_paths of read_text_blocks(path, block, line): files are scanned in parts, by as many tasks as they have
    blocks, and lines get their numbers in the whole file.

    A line's place in its block is told by the rising row number that its task gives it. Each block becomes one row, with
    its lines counted and its hits, which are part of one block's text; what the blocks before it hold is a running sum
    over the few rows of a file. Line ends are \\n, \\r and \\r\\n. A file with a line that is not UTF-8 gives one row, with
    line 0, and no other.
    """
    good = F.is_valid_utf8("line")
    rows = lines.withColumn("_id", F.monotonically_increasing_id())
    hit = F.when(good & F.col("line").rlike(pattern), F.struct("_id", F.regexp_extract("line", pattern, 0).alias("detail")))
    blocks = rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("_id").alias("first"), F.count_if(~good).alias("bad"), F.collect_list(hit).alias("hits"))
    whole = Window.partitionBy("path")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("bad", F.sum("bad").over(whole))
    found = blocks.where("bad = 0").select("path", "before", "first", F.explode("hits").alias("h"))
    found = found.select("path", (F.col("before") + F.col("h._id") - F.col("first") + 1).alias("line_no"), "h.detail")
    bad = blocks.where("bad > 0").select("path").distinct().select("path", F.lit(0).cast("long").alias("line_no"), F.lit("not UTF-8").alias("detail"))
    return found.unionByName(bad)


def manifest_file_diff(manifest: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """(path, issue): paths of the manifest that are not stored, and stored ones that it lacks."""
    listed, stored = manifest.select(F.col(column).alias("path")).distinct(), files.select("path").distinct()
    both = listed.withColumn("l", F.lit(1)).join(stored.withColumn("s", F.lit(1)), "path", "full")
    return both.where("l is null or s is null").select("path", F.when(F.col("s").isNull(), "missing").otherwise("not in manifest").alias("issue"))


def verify_pairs(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(stem, issue) where an image has no label file or a label file no image."""
    both = images.select("stem").distinct().withColumn("i", F.lit(1)).join(labels.select("stem").distinct().withColumn("l", F.lit(1)), "stem", "full")
    return both.where("i is null or l is null").select("stem", F.when(F.col("l").isNull(), "missing label").otherwise("extra label").alias("issue"))


def pair_counts(images: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: images, labels, instances (label lines that are not blank). labels(stem, n_lines)."""
    i = images.agg(F.count_distinct("stem").alias("images"))
    return i.crossJoin(labels.agg(F.count_distinct("stem").alias("labels"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("instances")))  # one row each


def require_pairs(images: DataFrame, labels: DataFrame, expected: int | None = None) -> None:
    """An error if images and labels do not pair or are not as many as expected."""
    bad = verify_pairs(images, labels).count()
    n = pair_counts(images, labels).first()
    if bad or expected is not None and (n["images"] != expected or n["labels"] != expected):
        raise ValueError(f"{n['images']} images, {n['labels']} labels, {bad} without a partner")


def split_summary(manifest: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(split, images, image_ratio, target_ratio, objects, small_boxes) for every split, empty ones too."""
    spark = manifest.sparkSession
    base = spark.createDataFrame([(k, float(v)) for k, v in targets.items()], "split string, target_ratio double")
    per = manifest.groupBy("split").agg(F.count("*").alias("images"), F.sum("object_count").alias("objects"), F.sum("small_box_count").alias("small_boxes"))
    total = manifest.agg(F.count("*").alias("_all"))
    out = base.join(per, "split", "left").crossJoin(total)  # three rows by one
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = F.when(F.col("_all") > 0, zero("images") / F.col("_all")).otherwise(F.lit(0.0))
    return out.select("split", zero("images").alias("images"), F.round(ratio, 6).alias("image_ratio"), "target_ratio", zero("objects").alias("objects"), zero("small_boxes").alias("small_boxes"))


def split_leaks(manifest: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(kind, key, splits): values of each key column that occur in more than one split; blank ones don't count."""
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("key")) for kind, c in keys.items()])
    rows = manifest.select("split", F.explode(pairs).alias("p")).select("split", "p.kind", "p.key").where("coalesce(key, '') != ''")
    return rows.groupBy("kind", "key").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def duplicate_count_differs(manifest: DataFrame) -> DataFrame:
    """(duplicate_group_id, counts): groups whose members' object_count texts differ."""
    rows = manifest.where("coalesce(duplicate_group_id, '') != ''")
    return rows.groupBy("duplicate_group_id").agg(F.count_distinct(F.col("object_count").cast("string")).alias("counts")).where("counts > 1")


def count_mismatch(manifest: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, object_count, rows) where the manifest's count is not the number of label boxes."""
    per = boxes.groupBy("image_id").agg(F.count("*").alias("rows"))
    out = manifest.select("image_id", "object_count").join(per, "image_id", "left").fillna(0, ["rows"])
    return out.where("object_count != rows")


def dataset_verdict(issues: DataFrame, manifest: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row: issues, images, listed and stored boxes, totals_match, valid."""
    i, m, b = issues.agg(F.count("*").alias("issues")), manifest.agg(F.count("*").alias("images"), F.coalesce(F.sum("object_count"), F.lit(0)).alias("listed_boxes")), boxes.agg(F.count("*").alias("stored_boxes"))
    out = i.crossJoin(m).crossJoin(b)  # one row each
    same = F.col("listed_boxes") == F.col("stored_boxes")
    return out.withColumn("totals_match", same).withColumn("valid", (F.col("issues") == 0) & same)


def preview_box_mismatch(images: DataFrame, rows: DataFrame) -> DataFrame:
    """(image_id, mismatch): differing dimensions, else the first label line with a bad class or a box outside."""
    dims = images.where("src_width != width or src_height != height").select("image_id", F.lit(0).alias("n"), F.lit("dimensions differ").alias("m"))
    px = yolo_to_pixels(F.col("xc"), F.col("yc"), F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    off = (px["xmin"] < 0) | (px["ymin"] < 0) | (px["xmax"] > F.col("width")) | (px["ymax"] > F.col("height")) | (px["xmax"] <= px["xmin"]) | (px["ymax"] <= px["ymin"])
    line = F.col("line_no").cast("string")
    bad = rows.select("image_id", F.col("line_no").alias("n"), F.when(F.col("class_id") != 0, F.concat(F.lit("unexpected class on line "), line)).when(off, F.concat(F.lit("box outside the image on line "), line)).alias("m")).where("m is not null")
    return dims.unionByName(bad).groupBy("image_id").agg(F.min_by("m", "n").alias("mismatch"))
