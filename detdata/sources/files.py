"""Readers of annotation, image, label, manifest and report files."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.image_headers import headers
from ..functions.scalars import parse_number, parse_strict_int, path_name, path_stem, path_suffix
from ..schemas import ANNOTATION_XML, AUDIT_SUFFIXES


def parse_annotations(files: DataFrame, path: str = "path", content: str = "value") -> DataFrame:
    """(xml_path, image_id, filename, path, size, object, _corrupt_record) from XML texts."""
    parsed = F.from_xml(F.col(content), ANNOTATION_XML, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return files.select(F.col(path).alias("xml_path"), path_stem(F.col(path)).alias("image_id"), parsed.alias("a")).select("xml_path", "image_id", "a.*")


def read_voc_annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row per XML file; one that can't be parsed keeps its row with _corrupt_record."""
    files = spark.read.option("pathGlobFilter", "*.xml").option("recursiveFileLookup", "true").text(path, wholetext=True)
    return parse_annotations(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def explode_boxes(annotations: DataFrame) -> DataFrame:
    """One row per object in document order, object_index from 1; coordinates stay text."""
    rows = annotations.select("xml_path", "image_id", "size", F.posexplode("object").alias("p", "o"))
    return rows.select("xml_path", "image_id", (F.col("p") + 1).alias("object_index"), F.trim("o.name").alias("class_name"), F.col("o.bndbox").isNotNull().alias("has_box"), *[F.trim(f"o.bndbox.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")], F.col("size.width").alias("xml_width"), F.col("size.height").alias("xml_height"))


def scan_images(spark: SparkSession, path: str, suffixes: tuple = AUDIT_SUFFIXES) -> DataFrame:
    """(path, length, suffix) of image files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", path_suffix(F.col("path")).alias("suffix")).where(F.col("suffix").isin(*suffixes))


def header_facts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, sha256, format, width, height, readable) of images held as bytes, in a folder or in a table. The bytes are
    read once and pass through one Arrow map, in batches of bounded size; nothing is shuffled.

    Sizes are those that the header states. An image whose header isn't whole (PNG: whose chunks aren't), or a null
    content, is not readable and has no format and size; a null content has no digest.
    """
    src = files.select(F.col(path).alias("path"), F.sha2(content, 256).alias("sha256"), F.col(content).alias("_content"))

    def run(batches):
        for b in batches:
            kinds, widths, heights = zip(*headers(b.column(2)), strict=True) if b.num_rows else ((), (), ())
            columns = [pa.array(kinds, pa.string()), pa.array(widths, pa.int64()), pa.array(heights, pa.int64()), pa.array([k is not None for k in kinds], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["path", "sha256", "format", "width", "height", "readable"])

    return src.mapInArrow(run, "path string, sha256 string, format string, width long, height long, readable boolean")


def image_facts(spark: SparkSession, path: str, suffixes: tuple = AUDIT_SUFFIXES) -> DataFrame:
    """header_facts of the image files below a folder, with those of 0 bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    known = F.lower(path_suffix(F.col("path"))).isin(*suffixes)
    empty = empty_files(spark, files).where(known).select("path", F.lit(b"").alias("content"))
    return header_facts(files.where(known)).unionByName(header_facts(empty))


def empty_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(path) of the files of 0 bytes of a binaryFile table. Spark's readers leave them out; they are the paths of its file
    listing, which the driver holds for every scan, that the scan doesn't return. No content is read for that."""
    listed = spark.createDataFrame([(p,) for p in files.inputFiles()], "_p string")
    plain = F.url_decode(F.replace("_p", F.lit("+"), F.lit("%2B")))  # a plus sign is one
    return listed.select(F.regexp_replace(plain, "^file:///", "file:/").alias("path")).join(files.select("path"), "path", "left_anti")


def label_rows(files: DataFrame, path: str = "path", content: str = "value") -> DataFrame:
    """(path, line_no from 1, line, tokens): a final line end makes no further line, a blank line inside does."""
    text = F.regexp_replace(F.coalesce(F.col(content), F.lit("")), r"(\r\n|\r|\n)\z", "")
    rows = files.select(F.col(path).alias("path"), F.when(F.col(content) != "", F.split(text, r"\R")).alias("_l")).select("path", F.posexplode("_l").alias("p", "line"))
    return rows.select("path", (F.col("p") + 1).alias("line_no"), "line", F.filter(F.split(F.trim("line"), r"\s+"), lambda t: t != "").alias("tokens"))


def read_label_rows(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return label_rows(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def label_boxes(rows: DataFrame) -> DataFrame:
    """Label rows with class_id, xc, yc, w, h parsed (null where the text is no number)."""
    t = lambda i: F.get("tokens", F.lit(i))
    return rows.withColumns({"n_values": F.size("tokens"), "class_id": parse_strict_int(t(0)), **{c: parse_number(t(i + 1)) for i, c in enumerate(("xc", "yc", "w", "h"))}})


def read_manifest(spark: SparkSession, path: str, required: tuple) -> DataFrame:
    """A CSV manifest, all text. A missing column or an empty file is an error."""
    df = spark.read.csv(path, header=True)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"manifest lacks {', '.join(missing)}")
    if df.isEmpty():
        raise ValueError("manifest has no rows")
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])


def read_split_lists(spark: SparkSession, path: str) -> DataFrame:
    """(list_name, list_path, image_id): the stem of the first token of each line that is not blank."""
    lines = spark.read.option("pathGlobFilter", "*.txt").text(path).select(path_stem(F.col("_metadata.file_path")).alias("list_name"), F.col("_metadata.file_path").alias("list_path"), F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)).alias("t"))
    return lines.where("t != ''").select("list_name", "list_path", path_stem(F.col("t")).alias("image_id"))


#: The part of an audit report that names duplicates, and how their findings name the group.
AUDIT_REPORT = "findings STRUCT<duplicate_images: ARRAY<STRUCT<path: STRING, detail: STRING>>>"
DUPLICATE_DETAIL = r"^Duplicate SHA-256 group: ([0-9a-f]{64})\.$"


def read_audit_duplicates(spark: SparkSession, path: str, images: DataFrame, lines: bool = False) -> DataFrame:
    """(image_id, path, duplicate_group_id) from an audit's JSON report (one document, or the lines of write_audit_report), with images(image_id, path) joined by file name.
    A finding of another form, or of an image that is not there, is an error."""
    report = spark.read.schema(AUDIT_REPORT).json(path, multiLine=not lines)
    rows = report.select(F.explode("findings.duplicate_images").alias("f")).select("f.path", F.regexp_extract("f.detail", DUPLICATE_DETAIL, 1).alias("duplicate_group_id"))
    names = images.groupBy(path_name(F.col("path")).alias("_name")).agg(F.max("image_id").alias("image_id"))
    rows = rows.join(names, path_name(F.col("path")) == F.col("_name"), "left").select("image_id", "path", "duplicate_group_id")
    bad = rows.agg(F.count_if(F.coalesce("duplicate_group_id", F.lit("")) == "").alias("form"), F.count_if(F.col("image_id").isNull()).alias("lost")).first()
    if bad["form"]:
        raise ValueError(f"{bad['form']} duplicate findings have an unexpected form")
    if bad["lost"]:
        raise ValueError(f"{bad['lost']} duplicate findings name an image that is not there")
    return rows


def read_epoch_results(spark: SparkSession, path: str, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Epoch rows with each metric from the first of its column names that parses. An empty file is an error."""
    df = spark.read.csv(path, header=True)
    df = df.toDF(*[c.strip() for c in df.columns])
    if df.isEmpty():
        raise ValueError("results have no rows")
    metric = lambda options: F.coalesce(*[F.col(f"`{c}`").try_cast("double") for c in options if c in df.columns], F.lit(None).cast("double"))
    return df.select(F.col("epoch").try_cast("int").alias("epoch"), *[metric(options).alias(name) for name, options in names.items()])


def read_previous_review(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, review_status, reviewer_notes): the last row of each id, in file order; blank ids go."""
    # a row's place: file, block of the file, row of the block
    rows = spark.read.csv(path, header=True).withColumn("_n", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    rows = rows.where(F.coalesce(F.trim("image_id"), F.lit("")) != "")
    return rows.groupBy("image_id").agg(*[F.max_by(F.coalesce(F.col(c), F.lit("")), "_n").alias(c) for c in ("review_status", "reviewer_notes")])


def scan_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) as bytes, for scans that must notice text that is not UTF-8."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_text_blocks(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, block, line) of text files below a folder; large files are read in blocks, a block being named by its first
    byte. Lines of a block come in their order, in one task."""
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def provenance(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, sha256) of the files a run depends on."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"))
