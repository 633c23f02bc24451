"""Label files that arrive over time, checked as they come."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import path_stem
from ..operators.quality import label_errors
from ..sources.files import label_boxes, label_rows


def incoming_labels(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """A stream of (path, value), one row per new label file."""
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def incoming_label_errors(files: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, line_no, error) of the files, against images(image_id, width, height), a static table."""
    rows = label_boxes(label_rows(files)).withColumn("image_id", path_stem(F.col("path")))
    return label_errors(rows.join(images.select("image_id", "width", "height"), "image_id"))


def write_label_errors(spark: SparkSession, path: str, images: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the errors of new label files to a Parquet table, each file once; processes what is there and ends."""
    errors = incoming_label_errors(incoming_labels(spark, path), images)
    return errors.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
