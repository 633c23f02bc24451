"""Conversion of boxes to normalised labels, with a preflight that names the first failure of each image."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box, conversion_error, voc_to_yolo, yolo_to_pixels
from ..schemas import SOURCE_CLASS


def convert_boxes(boxes: DataFrame) -> DataFrame:
    """Typed boxes with image width and height → (image_id, line_no, class_id, xc, yc, w, h) of those that convert."""
    out = boxes.withColumns(voc_to_yolo(box(), F.col("width"), F.col("height"))).where("xc is not null")
    return out.select("image_id", F.col("object_index").alias("line_no"), F.lit(0).alias("class_id"), "xc", "yc", "w", "h")


def label_pixels(labels: DataFrame, images: DataFrame) -> DataFrame:
    """Labels with the corners they stand for on their image."""
    on = labels.join(images.select("image_id", "width", "height"), "image_id")
    return on.withColumns(yolo_to_pixels(*[F.col(c) for c in ("xc", "yc", "w", "h")], F.col("width"), F.col("height")))


def conversion_preflight(images: DataFrame, boxes: DataFrame, source_class: str = SOURCE_CLASS) -> DataFrame:
    """(image_id, object_index, error): the first failure of each image, against the actual image size. An image that
    can't be read fails as a whole (object 0). Corners are numbers, null where the text was none."""
    whole = images.where("not readable").select("image_id", F.lit(0).alias("object_index"), F.lit("image cannot be read").alias("error"))
    missing = F.col("xmin").isNull() | F.col("ymin").isNull() | F.col("xmax").isNull() | F.col("ymax").isNull()
    error = F.when(F.coalesce("class_name", F.lit("")) != source_class, "unsupported source class").when(missing, "non-numeric bounding-box coordinate").otherwise(conversion_error(box(), F.col("width"), F.col("height")))
    rows = boxes.select("image_id", "object_index", error.alias("error")).where("error is not null").unionByName(whole)
    first = rows.groupBy("image_id").agg(F.min(F.struct("object_index", "error")).alias("f"))
    return first.select("image_id", "f.object_index", "f.error")


def require_convertible(failures: DataFrame) -> None:
    """Stops a job whose preflight found something; only the count comes to the driver."""
    n = failures.count()
    if n:
        raise ValueError(f"{n} images fail the conversion preflight")
