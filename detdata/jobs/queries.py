"""Registered queries: each operator on the derived tables, with its SQL twin where SQL can express it."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.geometry import box, box_geometry, coordinate_delta, iou, is_small_box
from ..operators import audit as A
from ..operators import convert as C
from ..operators import matching as M
from ..operators import metrics as X
from ..operators import quality as Q
from ..operators import review as R
from ..operators import sampling as P
from ..operators import split as G
from ..sources import files as IO
from ..sources import sinks as K
from ..storage import freed, new_path, written
from . import views as V

QUERIES, ORACLE_SQL = {}, {}
RATIOS = {"train": 0.7, "val": 0.15, "test": 0.15}


def query(name: str, sql: str | None = None, **tables: str):
    """Registers fn(spark, dir, tables...) under a name; sql may use the tables' names as views."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(*[V.view(spark, sf_dir, t) for t in tables.values()])
        if sql is not None:
            with_ = ", ".join(f"{k} AS ({V.duck(t)})" for k, t in tables.items())
            recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
            ORACLE_SQL[name] = f"WITH {recursive}{with_} {sql.replace('RECURSIVE', '')}" if with_ else sql
        return fn

    return add


VALID, SMALL = V.VALID, "(xmax - xmin <= 10 OR ymax - ymin <= 10)"
IOU = "(greatest(0, least(s.xmax, d.xmax) - greatest(s.xmin, d.xmin)) * greatest(0, least(s.ymax, d.ymax) - greatest(s.ymin, d.ymin)))"
PROBLEMS = """array_to_string(list_filter([CASE WHEN xmin < 0 OR ymin < 0 THEN 'minimum coordinate is negative' END, CASE WHEN xmax <= xmin OR ymax <= ymin THEN 'box has non-positive width or height' END,
 CASE WHEN xmax > width THEN 'xmax exceeds width' END, CASE WHEN ymax > height THEN 'ymax exceeds height' END], lambda x: x IS NOT NULL), '; ')"""


# ---- audit

@query("audit_invalid_boxes", f"SELECT 'invalid_boxes' AS category, image_id AS path, object_index, {PROBLEMS} AS detail FROM boxes WHERE NOT ({VALID})", boxes=V.BOXES)
def _(boxes):
    return A.find_invalid_boxes(boxes)


@query("audit_small_boxes", f"SELECT 'small_boxes' AS category, image_id AS path, object_index, 'side at or below the threshold' AS detail FROM boxes WHERE {VALID} AND {SMALL}", boxes=V.BOXES)
def _(boxes):
    return A.find_small_boxes(boxes, 10.0)


INVALID_ANN = """SELECT 'invalid_annotations' AS category, path, CAST(NULL AS INT) AS object_index, 'XML cannot be parsed' AS detail FROM ann WHERE parse_error IS NOT NULL
 UNION ALL SELECT 'invalid_annotations', path, NULL, 'no image reference' FROM ann WHERE parse_error IS NULL AND filename = '' AND ref_path = ''
 UNION ALL SELECT 'invalid_annotations', path, NULL, 'missing or invalid size' FROM ann WHERE parse_error IS NULL AND width IS NULL
 UNION ALL SELECT 'invalid_annotations', concat('xml/', image_id, '.xml'), object_index, 'object without name' FROM boxes WHERE class_name = ''"""


@query("audit_invalid_annotations", INVALID_ANN, ann=V.ANNOTATIONS, boxes=V.BOXES)
def _(ann, boxes):
    reference = ann.withColumn("reference", F.when(F.col("filename") != "", F.col("filename")).otherwise(F.col("ref_path")))
    return A.find_invalid_annotations(reference, boxes.withColumn("path", F.concat(F.lit("xml/"), "image_id", F.lit(".xml"))))


def _references(ann):
    return ann.where("parse_error is null").select(F.col("path").alias("xml_path"), "filename", F.col("ref_path").alias("path"))


RESOLVED = """im AS (SELECT path, regexp_extract(path, '[^/]+$') AS name FROM images), st AS (SELECT path, regexp_replace(name, '\\.[^.]+$', '') AS stem FROM im),
 rf AS (SELECT path AS xml_path, filename, ref_path, regexp_extract(filename, '[^/]+$') AS n0, regexp_extract(ref_path, '[^/]+$') AS n1 FROM ann WHERE parse_error IS NULL),
 rs AS (SELECT r.*, (SELECT min(path) FROM im WHERE name = n0 AND n0 <> '') AS e0, (SELECT min(path) FROM im WHERE name = n1 AND n1 <> '') AS e1,
  (SELECT min(path) FROM st WHERE stem = regexp_replace(n0, '\\.[^.]+$', '') AND n0 <> '') AS s0, (SELECT min(path) FROM st WHERE stem = regexp_replace(n1, '\\.[^.]+$', '') AND n1 <> '') AS s1 FROM rf r),
 rz AS (SELECT xml_path, filename, ref_path AS path, coalesce(e0, e1, s0, s1) AS image_path, coalesce(e0, e1) IS NULL AND coalesce(s0, s1) IS NOT NULL AS mismatch,
  CASE WHEN n0 <> '' THEN n0 WHEN n1 <> '' THEN n1 END AS reference FROM rs)"""


@query("resolve_images", f", {RESOLVED} SELECT * FROM rz", images=V.IMAGES, ann=V.ANNOTATIONS)
def _(images, ann):
    return A.resolve_images(_references(ann), images.select("path"))


@query("audit_missing_images", f", {RESOLVED} SELECT 'missing_images' AS category, xml_path AS path, CAST(NULL AS INT) AS object_index, coalesce('referenced image is missing: ' || reference, 'no image reference') AS detail FROM rz WHERE image_path IS NULL", images=V.IMAGES, ann=V.ANNOTATIONS)
def _(images, ann):
    return A.find_missing_images(A.resolve_images(_references(ann), images.select("path")))


@query("audit_missing_annotations", f", {RESOLVED} SELECT 'missing_xml' AS category, path, CAST(NULL AS INT) AS object_index, 'no annotation references this image' AS detail FROM images WHERE path NOT IN (SELECT image_path FROM rz WHERE image_path IS NOT NULL)", images=V.IMAGES, ann=V.ANNOTATIONS)
def _(images, ann):
    return A.find_missing_annotations(images.select("path"), A.resolve_images(_references(ann), images.select("path")))


@query("audit_extension_mismatches", f", {RESOLVED} SELECT 'extension_mismatches' AS category, xml_path AS path, CAST(NULL AS INT) AS object_index, reference || ' resolved to ' || regexp_extract(image_path, '[^/]+$') AS detail FROM rz WHERE mismatch", images=V.IMAGES, ann=V.ANNOTATIONS)
def _(images, ann):
    return A.find_extension_mismatches(A.resolve_images(_references(ann), images.select("path")))


SOURCE_IMAGE = """, nm AS (SELECT min(path) AS p, regexp_extract(path, '[^/]+$') AS name FROM images GROUP BY 2)
 SELECT a.image_id, a.filename, coalesce(n0.p, n1.p, n2.p, n3.p) AS image_path FROM ann a LEFT JOIN nm n0 ON n0.name = regexp_extract(trim(filename), '[^/]+$') LEFT JOIN nm n1 ON n1.name = image_id || '.jpg'
 LEFT JOIN nm n2 ON n2.name = image_id || '.jpeg' LEFT JOIN nm n3 ON n3.name = image_id || '.png'"""


@query("find_source_image", SOURCE_IMAGE, images=V.IMAGES, ann=V.ANNOTATIONS)
def _(images, ann):
    return A.find_source_image(ann.select("image_id", "filename"), images.select("path"))


@query("audit_corrupt_images", "SELECT 'corrupt_images' AS category, path, CAST(NULL AS INT) AS object_index, 'image cannot be read' AS detail FROM images WHERE NOT readable", images=V.IMAGES)
def _(images):
    return A.find_corrupt_images(images)


GROUPS = "SELECT sha256, count(*) AS n FROM images WHERE readable GROUP BY 1 HAVING count(*) > 1"


@query("duplicate_groups", GROUPS, images=V.IMAGES)
def _(images):
    return A.duplicate_groups(images)


@query("audit_duplicate_images", f"SELECT 'duplicate_images' AS category, path, CAST(NULL AS INT) AS object_index, 'SHA-256 group ' || sha256 AS detail FROM images WHERE readable AND sha256 IN (SELECT sha256 FROM ({GROUPS}))", images=V.IMAGES)
def _(images):
    return A.find_duplicate_images(images)


@query("document_duplicates", "SELECT sha256(text) AS sha256, count(*) AS n FROM d GROUP BY 1 HAVING count(*) > 1", d="SELECT text FROM {documents}")
def _(d):
    return A.duplicate_groups(d.select(S.content_digest(F.col("text")).alias("sha256"), F.lit(True).alias("readable")))


@query("class_counts", "SELECT class_name, count(*) AS n FROM boxes WHERE class_name <> '' GROUP BY 1", boxes=V.BOXES)
def _(boxes):
    return A.class_counts(boxes)


@query("box_counts_per_image", f"SELECT i.image_id, coalesce(n, 0) AS object_count, coalesce(s, 0) AS small_box_count FROM images i LEFT JOIN (SELECT image_id, count(*) AS n, count(*) FILTER (WHERE {SMALL}) AS s FROM boxes GROUP BY 1) b USING (image_id)", images=V.IMAGES, boxes=V.BOXES)
def _(images, boxes):
    return A.box_counts_per_image(images, boxes, 10.0)


def audit_findings(images, ann, boxes):
    resolved = written(A.resolve_images(_references(ann), images.select("path")), "resolved")
    reference = ann.withColumn("reference", F.when(F.col("filename") != "", F.col("filename")).otherwise(F.col("ref_path")))
    paths = boxes.withColumn("path", F.concat(F.lit("xml/"), "image_id", F.lit(".xml")))
    return A.union([A.find_missing_images(resolved), A.find_missing_annotations(images.select("path"), resolved), A.find_extension_mismatches(resolved), A.find_invalid_annotations(reference, paths), A.find_invalid_boxes(boxes), A.find_small_boxes(boxes, 10.0), A.find_corrupt_images(images), A.find_duplicate_images(images)])


SUMMARY = f""", {RESOLVED} SELECT 'missing_images' AS metric, '' AS key, count(*) AS value FROM rz WHERE image_path IS NULL UNION ALL SELECT 'missing_xml', '', count(*) FROM images WHERE path NOT IN (SELECT image_path FROM rz WHERE image_path IS NOT NULL)
 UNION ALL SELECT 'extension_mismatches', '', count(*) FROM rz WHERE mismatch UNION ALL SELECT 'invalid_annotations', '', count(*) FROM ({INVALID_ANN}) UNION ALL SELECT 'invalid_boxes', '', count(*) FROM boxes WHERE NOT ({VALID})
 UNION ALL SELECT 'small_boxes', '', count(*) FROM boxes WHERE {VALID} AND {SMALL} UNION ALL SELECT 'corrupt_images', '', count(*) FROM images WHERE NOT readable UNION ALL SELECT 'duplicate_images', '', count(*) FROM images WHERE readable AND sha256 IN (SELECT sha256 FROM ({GROUPS}))
 UNION ALL SELECT 'images', '', count(*) FROM images UNION ALL SELECT 'annotations', '', count(*) FROM ann UNION ALL SELECT 'objects', '', count(*) FROM boxes UNION ALL SELECT 'classes', '', count(DISTINCT class_name) FROM boxes WHERE class_name <> ''
 UNION ALL SELECT 'object_class', class_name, count(*) FROM boxes WHERE class_name <> '' GROUP BY 2 UNION ALL SELECT 'very_small_box_definition', 'width or height <= 10 pixels', NULL"""


@query("audit_summary", SUMMARY, images=V.IMAGES, ann=V.ANNOTATIONS, boxes=V.BOXES)
def _(images, ann, boxes):
    boxes = written(boxes.select("image_id", "object_index", "class_name", "xmin", "ymin", "xmax", "ymax", "width", "height"), "boxes")
    return A.audit_summary(audit_findings(images, ann, boxes), images, ann, boxes, 10.0)


# ---- scalars

PATHS = "SELECT concat(CASE WHEN o_orderkey % 11 = 0 THEN '/abs/' WHEN o_orderkey % 13 = 0 THEN 'C:\\\\x\\\\' ELSE 'rel/' END, CASE WHEN o_orderkey % 7 = 0 THEN '.hidden' WHEN o_orderkey % 5 = 0 THEN 'a.tar.GZ' ELSE 'img.JPG' END) AS p, o_orderkey AS k FROM {orders}".replace("'C:\\\\x\\\\'", "concat('C:', chr(92), 'x', chr(92))")


@query("path_parts", "SELECT k, regexp_extract(p, '[^/]*$') AS name, regexp_replace(regexp_extract(p, '[^/]*$'), '^(.+)\\.[^.]+$', '\\1') AS stem, lower(regexp_extract(regexp_extract(p, '[^/]*$'), '^.+\\.([^.]+)$', 1)) AS suffix, (p LIKE '/%' OR regexp_matches(p, '^[A-Za-z]:[\\\\/]')) AS absolute FROM paths", paths=PATHS)
def _(paths):
    p = F.col("p")
    return paths.select("k", S.path_name(p).alias("name"), S.path_stem(p).alias("stem"), S.path_suffix(p).alias("suffix"), S.is_absolute_path(p).alias("absolute"))


TEXTS = "SELECT l_orderkey AS k, CASE l_partkey % 9 WHEN 0 THEN 'nan' WHEN 1 THEN ' 20.0 ' WHEN 2 THEN '-3' WHEN 3 THEN '1e3' WHEN 4 THEN 'abc' WHEN 5 THEN '' WHEN 6 THEN '20' WHEN 7 THEN '7.5' ELSE 'inf' END AS t FROM {lineitem}"


@query("parse_numbers", "SELECT t, count(*) AS n, CASE t WHEN ' 20.0 ' THEN 20.0 WHEN '-3' THEN -3 WHEN '1e3' THEN 1000 WHEN '20' THEN 20 WHEN '7.5' THEN 7.5 END::DOUBLE AS number, CASE t WHEN ' 20.0 ' THEN 20 WHEN '1e3' THEN 1000 WHEN '20' THEN 20 END::BIGINT AS positive, CASE t WHEN '-3' THEN -3 WHEN '20' THEN 20 END::BIGINT AS strict FROM texts GROUP BY 1", texts=TEXTS)
def _(texts):
    t = F.col("t")
    return texts.groupBy("t").agg(F.count("*").alias("n")).select("t", "n", S.parse_number(t).alias("number"), S.parse_positive_integer(t).alias("positive"), S.parse_strict_int(t).alias("strict"))


@query("class_mapping", "SELECT image_id, object_index, CASE class_name WHEN 'fore' THEN 0 END AS class_id FROM boxes", boxes=V.BOXES)
def _(boxes):
    return boxes.select("image_id", "object_index", S.map_class(F.col("class_name"), {"fore": 0}).alias("class_id"))


@query("box_geometry", f"SELECT image_id, object_index, xmax - xmin AS box_width, ymax - ymin AS box_height, (xmax - xmin) * (ymax - ymin) AS area, CASE WHEN xmax > xmin AND ymax > ymin THEN greatest((xmax - xmin) / (ymax - ymin), (ymax - ymin) / (xmax - xmin)) END AS aspect, {SMALL} AS small FROM boxes", boxes=V.BOXES)
def _(boxes):
    return boxes.withColumns({**box_geometry(box()), "small": is_small_box(box(), 10.0)}).select("image_id", "object_index", "box_width", "box_height", "area", "aspect", "small")


# ---- conversion

@query("convert_boxes", f"SELECT image_id, object_index AS line_no, 0 AS class_id, (xmin + xmax) / 2 / width AS xc, (ymin + ymax) / 2 / height AS yc, (xmax - xmin) / width AS w, (ymax - ymin) / height AS h FROM boxes WHERE {VALID}", boxes=V.BOXES)
def _(boxes):
    return C.convert_boxes(boxes)


PIXELS = "(xc - w / 2) * l.width AS xmin, (yc - h / 2) * l.height AS ymin, (xc + w / 2) * l.width AS xmax, (yc + h / 2) * l.height AS ymax"


@query("label_pixels", f"SELECT l.image_id, l.line_no, {PIXELS} FROM labels l", labels=V.LABELS, images=V.IMAGES)
def _(labels, images):
    return C.label_pixels(labels.drop("width", "height"), images).select("image_id", "line_no", "xmin", "ymin", "xmax", "ymax")


@query("conversion_preflight", f"""SELECT image_id, min(object_index) AS object_index, arg_min(error, object_index) AS error FROM (
 SELECT image_id, object_index, CASE WHEN class_name <> 'fore' THEN 'unsupported source class' WHEN xmin < 0 OR ymin < 0 OR xmax <= xmin OR ymax <= ymin THEN 'Bounding box has negative coordinates or non-positive size.'
  WHEN xmax > width OR ymax > height THEN 'Bounding box exceeds actual image dimensions.' END AS error FROM boxes WHERE class_name <> 'fore' OR NOT ({VALID})
 UNION ALL SELECT image_id, 0, 'image cannot be read' FROM images WHERE NOT readable) GROUP BY 1""", images=V.IMAGES, boxes=V.BOXES)
def _(images, boxes):
    return C.conversion_preflight(images, boxes)


# ---- validation

OUT = "(isnan({0}) OR {0} < 0 OR {0} > 1)"
ERRS = f"""SELECT image_id, line_no, e AS error FROM (SELECT image_id, line_no, unnest(list_filter([CASE WHEN n_values <> 5 THEN 'label_line_' || line_no || '_does_not_have_five_values' END,
 CASE WHEN n_values = 5 AND class_id <> 0 THEN 'invalid_class_id_line_' || line_no END,
 CASE WHEN n_values = 5 AND ({' OR '.join(OUT.format(c) for c in ('xc', 'yc', 'w', 'h'))}) THEN 'invalid_normalized_coordinate_line_' || line_no END,
 CASE WHEN n_values = 5 AND (w <= 0 OR h <= 0) THEN 'non_positive_box_size_line_' || line_no END,
 CASE WHEN n_values = 5 AND ((xc - w / 2) * width < 0 OR (yc - h / 2) * height < 0 OR (xc + w / 2) * width > width OR (yc + h / 2) * height > height OR (xc + w / 2) * width <= (xc - w / 2) * width OR (yc + h / 2) * height <= (yc - h / 2) * height) THEN 'reconstructed_box_outside_image_line_' || line_no END
 ], lambda x: x IS NOT NULL)) AS e FROM labels)"""


@query("label_errors", ERRS, labels=V.LABELS)
def _(labels):
    return Q.label_errors(labels)


DIMS = "SELECT image_id, width AS src_width, height AS src_height, width AS xml_width, CASE WHEN k % 601 = 0 THEN height + 1 ELSE height END AS xml_height, CASE WHEN k % 607 = 0 THEN width - 1 ELSE width END AS conv_width, height AS conv_height FROM (" + V.IMAGES + ") i"


@query("dimension_conflicts", """SELECT image_id, unnest(list_filter([CASE WHEN src_width <> conv_width OR src_height <> conv_height THEN 'source_and_converted_dimensions_conflict' END,
 CASE WHEN src_width <> xml_width OR src_height <> xml_height THEN 'source_image_and_xml_dimensions_conflict' END, CASE WHEN xml_width <> conv_width OR xml_height <> conv_height THEN 'source_xml_and_converted_dimensions_conflict' END], lambda x: x IS NOT NULL)) AS conflict FROM dims""", dims=DIMS)
def _(dims):
    return Q.dimension_conflicts(dims)


PARTS = "SELECT image_id, k % 211 <> 0 AS has_xml, k % 223 <> 0 AS has_source, k % 227 <> 0 AS has_converted, k % 229 <> 0 AS has_label FROM (" + V.IMAGES + ") i"


@query("missing_parts", "SELECT image_id, 'missing_source_xml' AS part FROM parts WHERE NOT has_xml UNION ALL SELECT image_id, 'missing_source_image' FROM parts WHERE NOT has_source UNION ALL SELECT image_id, 'missing_converted_image' FROM parts WHERE NOT has_converted UNION ALL SELECT image_id, 'missing_converted_label' FROM parts WHERE NOT has_label", parts=PARTS)
def _(parts):
    return Q.missing_parts(parts)


@query("invalid_split_values", "SELECT image_id, split FROM m WHERE split NOT IN ('train', 'val', 'test')", m=V.MANIFEST)
def _(m):
    return Q.invalid_split_values(m)


META = "SELECT image_id, CASE WHEN k % 53 = 0 THEN '3.0' WHEN k % 59 = 0 THEN 'x' ELSE CAST(k AS {string}) END AS object_count, CASE WHEN k % 61 = 0 THEN '' ELSE '01' END AS small_box_count, k FROM (" + V.IMAGES + ") i"
META = META.replace("{string}", "VARCHAR(20)")


@query("non_integer_metadata", "SELECT image_id, object_count, small_box_count FROM m WHERE k % 53 = 0 OR k % 59 = 0 OR k % 61 = 0", m=META)
def _(m):
    return Q.non_integer_metadata(m)


@query("absolute_manifest_paths", "SELECT image_id, 'source_image_path' AS field, source_image_path AS value FROM m WHERE source_image_path LIKE '/%'", m=V.MANIFEST)
def _(m):
    return Q.absolute_manifest_paths(m)


SCAN = "SELECT CAST(page_id AS VARCHAR(20)) AS path, concat(html, chr(10), CASE WHEN page_id % 7 = 0 THEN 'see /home/user/x.png now' WHEN page_id % 11 = 0 THEN '<b>src=/tmp/a' WHEN page_id % 13 = 0 THEN '/opt/data/y \"/var/z\"' WHEN page_id % 17 = 0 THEN '/root/x a-/mnt/b' ELSE 'b/home/c' END) AS content FROM {pages}"
# no look-behind there: what stands before is matched too
MACHINE = r"""(?:^|[^A-Za-z0-9_.-])((?:/(?:Users|home|private|tmp|var|opt|mnt)/[^\s"'']*|[A-Za-z]:\\[^\s"'']*))"""
BREAK = r"\r\n|\n|\r"


@query("scan_absolute_paths", f"SELECT path, line_no, regexp_extract(line, '{MACHINE}', 1) AS detail FROM (SELECT path, unnest(string_split_regex(content, '{BREAK}')) AS line, generate_subscripts(string_split_regex(content, '{BREAK}'), 1)::INT AS line_no FROM s) WHERE regexp_matches(line, '{MACHINE}')", s=SCAN)
def _(s):
    return Q.scan_absolute_paths(s.withColumn("content", F.col("content").cast("binary")))


@query("scan_path_lines", f"""SELECT bucket, n AS line_no, regexp_extract(line, '{MACHINE}', 1) AS detail FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY page_id, i) AS n FROM
 (SELECT page_id, CAST(page_id % 8 AS VARCHAR) AS bucket, unnest(string_split_regex(content, '{BREAK}')) AS line, unnest(range(len(string_split_regex(content, '{BREAK}')))) AS i FROM (SELECT path::BIGINT AS page_id, content FROM s))) WHERE regexp_matches(line, '{MACHINE}')""", s=SCAN)
def _(s):
    path = new_path(s.sparkSession, "lines")
    rows = s.select(F.col("path").cast("long").alias("page_id"), "content").withColumn("bucket", F.col("page_id") % 8)
    # a file for each bucket, its pages in order
    rows.repartition("bucket").sortWithinPartitions("bucket", "page_id").select("bucket", F.col("content").alias("value")).write.partitionBy("bucket").text(path)
    found = Q.scan_path_lines(IO.read_text_blocks(s.sparkSession, path))
    return found.select(F.regexp_extract("path", "bucket=([0-9]+)/", 1).alias("bucket"), "line_no", "detail")


STORED = "SELECT image_path AS path FROM (" + V.MANIFEST + ") m WHERE k % 401 <> 0 UNION ALL SELECT concat('images/extra_', image_id) FROM (" + V.MANIFEST + ") m WHERE k % 409 = 0"


@query("manifest_file_diff", "SELECT coalesce(l.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'missing' ELSE 'not in manifest' END AS issue FROM (SELECT DISTINCT image_path AS path FROM m) l FULL JOIN (SELECT DISTINCT path FROM f) s ON l.path = s.path WHERE l.path IS NULL OR s.path IS NULL", m=V.MANIFEST, f=STORED)
def _(m, f):
    return Q.manifest_file_diff(m, f, "image_path")


STEMS_I = "SELECT image_id AS stem FROM (" + V.IMAGES + ") i WHERE k % 433 <> 0"
STEMS_L = "SELECT image_id AS stem, CAST(k % 4 AS BIGINT) AS n_lines FROM (" + V.IMAGES + ") i WHERE k % 439 <> 0"


@query("verify_pairs", "SELECT coalesce(i.stem, l.stem) AS stem, CASE WHEN l.stem IS NULL THEN 'missing label' ELSE 'extra label' END AS issue FROM i FULL JOIN l ON i.stem = l.stem WHERE i.stem IS NULL OR l.stem IS NULL", i=STEMS_I, l=STEMS_L)
def _(i, l):
    return Q.verify_pairs(i, l)


@query("pair_counts", "SELECT (SELECT count(DISTINCT stem) FROM i) AS images, count(DISTINCT stem) AS labels, sum(n_lines)::BIGINT AS instances FROM l", i=STEMS_I, l=STEMS_L)
def _(i, l):
    return Q.pair_counts(i, l)


@query("split_summary", "SELECT t.split, count(m.image_id) AS images, round(count(m.image_id) / (SELECT count(*) FROM m), 6) AS image_ratio, max(t.r) AS target_ratio, coalesce(sum(object_count), 0)::BIGINT AS objects, coalesce(sum(small_box_count), 0)::BIGINT AS small_boxes FROM (VALUES ('train', 0.7::DOUBLE), ('val', 0.15), ('test', 0.15)) t(split, r) LEFT JOIN m ON m.split = t.split GROUP BY 1", m=V.MANIFEST)
def _(m):
    return Q.split_summary(m, RATIOS)


@query("split_leaks", "SELECT kind, key, count(DISTINCT split) AS splits FROM (SELECT 'group' AS kind, duplicate_group_id AS key, split FROM m UNION ALL SELECT 'image', image_id, split FROM m) WHERE key <> '' GROUP BY 1, 2 HAVING count(DISTINCT split) > 1", m=V.MANIFEST)
def _(m):
    return Q.split_leaks(m, {"group": "duplicate_group_id", "image": "image_id"})


@query("duplicate_count_differs", "SELECT duplicate_group_id, count(DISTINCT object_count) AS counts FROM m WHERE duplicate_group_id <> '' GROUP BY 1 HAVING count(DISTINCT object_count) > 1", m=V.MANIFEST)
def _(m):
    return Q.duplicate_count_differs(m)


@query("count_mismatch", "SELECT m.image_id, object_count, coalesce(n, 0) AS rows FROM m LEFT JOIN (SELECT image_id, count(*) AS n FROM labels GROUP BY 1) l ON l.image_id = m.image_id WHERE object_count <> coalesce(n, 0)", m=V.MANIFEST, labels=V.LABELS)
def _(m, labels):
    return Q.count_mismatch(m, labels)


@query("dataset_verdict", f", e AS ({ERRS}) SELECT i.n AS issues, mm.images, mm.listed_boxes, l.n AS stored_boxes, mm.listed_boxes = l.n AS totals_match, i.n = 0 AND mm.listed_boxes = l.n AS valid FROM (SELECT count(*) AS n FROM e) i, (SELECT count(*) AS images, sum(object_count)::BIGINT AS listed_boxes FROM m) mm, (SELECT count(*) AS n FROM labels) l", m=V.MANIFEST, labels=V.LABELS)
def _(m, labels):
    return Q.dataset_verdict(Q.label_errors(labels), m, labels)


@query("preview_box_mismatch", """SELECT image_id, arg_min(m, n) AS mismatch FROM (SELECT image_id, 0 AS n, 'dimensions differ' AS m FROM dims WHERE src_width <> conv_width
 UNION ALL SELECT image_id, line_no, CASE WHEN class_id <> 0 THEN 'unexpected class on line ' || line_no WHEN (xc - w / 2) * width < 0 OR (yc - h / 2) * height < 0 OR (xc + w / 2) * width > width OR (yc + h / 2) * height > height OR (xc + w / 2) * width <= (xc - w / 2) * width OR (yc + h / 2) * height <= (yc - h / 2) * height THEN 'box outside the image on line ' || line_no END FROM labels) WHERE m IS NOT NULL GROUP BY 1""", dims=DIMS, labels=V.LABELS)
def _(dims, labels):
    return Q.preview_box_mismatch(dims.select("image_id", "src_width", "src_height", F.col("conv_width").alias("width"), F.col("conv_height").alias("height")), labels)


# ---- matching

CONV = f"SELECT image_id, line_no AS object_index, {PIXELS} FROM ({V.LABELS}) l WHERE n_values = 5"
PAIRS = """SELECT image_id, s_index, d_index, i / u AS iou, delta FROM (SELECT s.image_id, s.object_index AS s_index, d.object_index AS d_index, {iou} AS i,
 (s.xmax - s.xmin) * (s.ymax - s.ymin) + (d.xmax - d.xmin) * (d.ymax - d.ymin) - {iou} AS u, greatest(abs(s.xmin - d.xmin), abs(s.ymin - d.ymin), abs(s.xmax - d.xmax), abs(s.ymax - d.ymax)) AS delta
 FROM src s JOIN conv d ON s.image_id = d.image_id) WHERE i > 0 AND u > 0 AND i / u > 0""".replace("{iou}", IOU)


@query("pair_boxes", PAIRS, src=V.SOURCE, conv=CONV)
def _(src, conv):
    return M.pair_boxes(src, conv).select("image_id", "s_index", "d_index", "iou", "delta")


@query("pair_boxes_dense", PAIRS, src=V.SOURCE, conv=CONV)
def _(src, conv):
    return M.pair_boxes_dense(src, conv).select("image_id", "s_index", "d_index", "iou", "delta")


MATCH = f"""RECURSIVE , p AS ({PAIRS}), o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY iou DESC, s_index DESC, d_index DESC) AS n FROM p),
 f AS (SELECT image_id, 0::BIGINT AS n, []::INT[] AS us, []::INT[] AS ud FROM o GROUP BY 1
  UNION ALL SELECT f.image_id, o.n, CASE WHEN list_contains(us, s_index) OR list_contains(ud, d_index) THEN us ELSE list_append(us, s_index) END, CASE WHEN list_contains(us, s_index) OR list_contains(ud, d_index) THEN ud ELSE list_append(ud, d_index) END
  FROM f JOIN o ON o.image_id = f.image_id AND o.n = f.n + 1),
 l AS (SELECT image_id, arg_max(us, n) AS us, arg_max(ud, n) AS ud FROM f GROUP BY 1),
 z AS (SELECT image_id, unnest(us) AS s_index, unnest(ud) AS d_index FROM l),
 mt AS (SELECT z.*, p.iou, p.delta FROM z JOIN p USING (image_id, s_index, d_index))"""


@query("match_boxes", f"{MATCH} SELECT * FROM mt", src=V.SOURCE, conv=CONV)
def _(src, conv):
    return M.match_image_boxes(src, conv)


# few images with hundreds of boxes each, whose sides go from 4 to 40,000 pixels
CROWD = """SELECT concat('crowd_', l_suppkey % {n}) AS image_id, CAST(row_number() OVER (PARTITION BY l_suppkey % {n} ORDER BY l_orderkey, l_linenumber, l_partkey) AS INT) AS object_index, CAST(l_orderkey * 7919 % 60000 AS DOUBLE) AS x, CAST(l_partkey * 104729 % 50000 AS DOUBLE) AS y,
 CAST(CASE WHEN l_partkey % 150 = 0 THEN 40000 WHEN l_partkey % 20 = 1 THEN 2500 WHEN l_partkey % 4 = 2 THEN 150 ELSE 4 END AS DOUBLE) AS side, l_linenumber AS ln, l_partkey AS pk FROM {lineitem}""".replace("{n}", "83")
CROWD_S = f"SELECT image_id, object_index, x AS xmin, y AS ymin, x + side AS xmax, y + side * 0.75D AS ymax FROM ({CROWD}) c"
CROWD_D = f"SELECT image_id, object_index, x + ln * side / 16 AS xmin, y AS ymin, x + side + ln * side / 16 AS xmax, y + side * 0.75D AS ymax FROM ({CROWD}) c WHERE pk % 7 <> 0"


@query("pair_boxes_crowded", PAIRS, src=CROWD_S, conv=CROWD_D)
def _(src, conv):
    return M.pair_boxes(src, conv).select("image_id", "s_index", "d_index", "iou", "delta")


@query("match_boxes_crowded", f"{MATCH} SELECT * FROM mt", src=CROWD_S, conv=CROWD_D)
def _(src, conv):
    # rounds for images with more than 2,000 candidate pairs, in order for the others
    return M.match_image_boxes(src, conv, 2000)


STATS = """st AS (SELECT i.image_id, coalesce(s, 0) AS source_count, coalesce(d, 0) AS converted_count, min_iou, mean_iou, max_delta, coalesce(s, 0) - coalesce(n, 0) AS unmatched_source, coalesce(d, 0) - coalesce(n, 0) AS unmatched_converted FROM images i
 LEFT JOIN (SELECT image_id, count(*) AS s FROM src GROUP BY 1) a USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS d FROM conv GROUP BY 1) b USING (image_id)
 LEFT JOIN (SELECT image_id, count(*) AS n, min(iou) AS min_iou, round(avg(iou), 6) AS mean_iou, max(delta) AS max_delta FROM mt GROUP BY 1) c USING (image_id))"""


@query("match_stats", f"{MATCH}, {STATS} SELECT * FROM st", src=V.SOURCE, conv=CONV, images=V.IMAGES)
def _(src, conv, images):
    return M.match_stats(images, src, conv, M.match_image_boxes(src, conv)).withColumn("mean_iou", F.round("mean_iou", 6))


# ---- verdicts

#: What is known of each image, with planted faults.
FACTS = """SELECT i.image_id, m.split, m.small_box_count, m.source_image_path, m.source_xml_path, m.label_path, m.grp, k % 211 <> 0 AS has_xml, k % 223 <> 0 AS has_source, k % 227 <> 0 AS has_converted, k % 229 <> 0 AS has_label, readable AS src_readable, TRUE AS conv_readable,
 src_width, src_height, xml_width, xml_height, conv_width, conv_height, k % 83 = 0 AS duplicate_count_differs, k % 499 = 0 AS duplicate_crosses_split, k % 1013 = 0 AS in_several_splits FROM ({images_}) i JOIN ({dims_}) d ON i.image_id = d.image_id JOIN (SELECT image_id AS mid, split, small_box_count, source_image_path, source_xml_path, label_path, duplicate_group_id AS grp FROM ({manifest_}) z) m ON i.image_id = m.mid"""
FACTS = FACTS.replace("{images_}", V.IMAGES).replace("{dims_}", DIMS).replace("{manifest_}", V.MANIFEST)

_R = {
    "xml": "CASE WHEN NOT has_xml THEN 'missing_source_xml' END", "source": "CASE WHEN has_xml AND NOT has_source THEN 'missing_source_image' END",
    "src_xml": "CASE WHEN has_xml AND has_source AND src_readable AND (src_width <> xml_width OR src_height <> xml_height) THEN 'source_image_and_xml_dimensions_conflict' END",
    "src_bad": "CASE WHEN has_xml AND has_source AND NOT src_readable THEN 'unreadable_source_image' END", "conv": "CASE WHEN NOT has_converted THEN 'missing_converted_image' END",
    "xml_conv": "CASE WHEN has_xml AND has_converted AND (xml_width <> conv_width OR xml_height <> conv_height) THEN 'source_xml_and_converted_dimensions_conflict' END",
    "src_conv": "CASE WHEN has_source AND has_converted AND (src_width <> conv_width OR src_height <> conv_height) THEN 'source_and_converted_dimensions_conflict' END",
    "label": "CASE WHEN NOT has_label THEN 'missing_converted_label' END", "counts": "CASE WHEN source_count <> converted_count THEN 'source_and_converted_object_counts_differ' END",
    "unmatched": "CASE WHEN unmatched_source > 0 OR unmatched_converted > 0 THEN 'unmatched_source_or_converted_boxes' END", "crosses": "CASE WHEN duplicate_crosses_split THEN 'duplicate_group_crosses_splits' END",
    "several": "CASE WHEN in_several_splits THEN 'filename_occurs_in_multiple_splits' END", "delta": "CASE WHEN max_delta > 1.0 THEN 'maximum_coordinate_difference_exceeds_1px' END",
    "iou": "CASE WHEN min_iou < 0.99 THEN 'minimum_matched_iou_below_0.99' END", "small": "CASE WHEN small > 0 THEN 'contains_very_small_box' END", "differs": "CASE WHEN duplicate_count_differs THEN 'duplicate_group_annotation_counts_differ' END",
}


def _verdict_sql(before: str, after: str, review: str, small: str) -> str:
    pick = lambda keys: "list_filter([" + ", ".join(_R[k] for k in keys.split()) + "], lambda x: x IS NOT NULL)"
    stats = STATS.replace("FROM images i", "FROM facts i")
    return f"""{MATCH}, {stats}, er AS (SELECT image_id, list(error ORDER BY line_no, r) AS label_errors FROM (SELECT *, CASE WHEN error LIKE 'label_line%' THEN 0 WHEN error LIKE 'invalid_class%' THEN 1 WHEN error LIKE 'invalid_norm%' THEN 2 WHEN error LIKE 'non_pos%' THEN 3 ELSE 4 END AS r FROM ({ERRS})) GROUP BY 1),
 sm AS (SELECT image_id, count(*) FILTER (WHERE {SMALL}) AS small_n FROM src GROUP BY 1),
 j AS (SELECT facts.*, st.* EXCLUDE (image_id), coalesce(label_errors, []) AS label_errors, {small} AS small FROM facts JOIN st USING (image_id) LEFT JOIN er USING (image_id) LEFT JOIN sm USING (image_id)),
 v AS (SELECT *, list_concat(list_concat({pick(before)}, label_errors), {pick(after)}) AS rj, {pick(review)} AS rv FROM j),
 vd AS (SELECT image_id, split, source_count, converted_count, round(max_delta, 6) AS max_delta, round(min_iou, 6) AS min_iou, CASE WHEN len(rj) > 0 THEN 'REJECT' WHEN len(rv) > 0 THEN 'NEEDS_REVIEW' ELSE 'PASS' END AS status, list_concat(rj, rv) AS reasons FROM v)"""


V1 = _verdict_sql("xml source src_xml src_bad conv xml_conv label", "counts unmatched crosses several", "delta iou small differs", "coalesce(small_n, 0)")
V2 = _verdict_sql("xml label conv source src_conv src_xml src_bad xml_conv", "counts unmatched several crosses", "delta iou differs small", "small_box_count").replace("'REJECT'", "'Reject'").replace("'NEEDS_REVIEW'", "'Needs review'").replace("'PASS'", "'Pass'")
SHOWN = "image_id, split, source_count, converted_count, max_delta, min_iou, status, array_to_string(reasons, ';') AS reasons"
REVIEW_TABLES = {"facts": FACTS, "src": V.SOURCE, "labels": V.LABELS}


def _shown(df):
    return df.select("image_id", "split", "source_count", "converted_count", F.round("max_delta", 6).alias("max_delta"), F.round("min_iou", 6).alias("min_iou"), "status", S.reasons_text(F.col("reasons")).alias("reasons"))


def _v1(facts, src, labels):
    return R.review_records(facts.withColumnRenamed("grp", "group"), src, labels, 10.0)


@query("review_records", f"{V1} SELECT {SHOWN} FROM vd", conv=CONV, **REVIEW_TABLES)
def _(_conv, facts, src, labels):
    return _shown(_v1(facts, src, labels))


@query("review_previews", f"{V2} SELECT {SHOWN} FROM vd", conv=CONV, **REVIEW_TABLES)
def _(_conv, facts, src, labels):
    return _shown(R.review_previews(facts, src, labels, 10.0))


@query("status_counts", f"{V1} SELECT s AS status, count(vd.image_id) AS n FROM (VALUES ('PASS'), ('NEEDS_REVIEW'), ('REJECT')) t(s) LEFT JOIN vd ON status = s GROUP BY 1", conv=CONV, **REVIEW_TABLES)
def _(_conv, facts, src, labels):
    return R.status_counts(_v1(facts, src, labels))


REASONS = "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM vd WHERE status = 'NEEDS_REVIEW') GROUP BY 1"
CATEGORIES = """SELECT category, count(*) AS n FROM (SELECT CASE WHEN list_has_any(reasons, ['maximum_coordinate_difference_exceeds_1px', 'minimum_matched_iou_below_0.99']) THEN 'coordinate_or_iou_concern' WHEN list_contains(reasons, 'duplicate_group_annotation_counts_differ') THEN 'duplicate_annotation_count_difference' WHEN list_distinct(reasons) = ['contains_very_small_box'] THEN 'very_small_box_only' ELSE 'other_reason' END AS category FROM vd WHERE status = 'NEEDS_REVIEW'
 UNION ALL SELECT 'both_reasons' FROM vd WHERE status = 'NEEDS_REVIEW' AND list_contains(reasons, 'duplicate_group_annotation_counts_differ') AND list_contains(reasons, 'contains_very_small_box')) GROUP BY 1"""
MISMATCHES = "SELECT image_id, status FROM vd WHERE list_has_any(reasons, ['source_and_converted_object_counts_differ', 'unmatched_source_or_converted_boxes', 'maximum_coordinate_difference_exceeds_1px', 'minimum_matched_iou_below_0.99'])"


@query("reason_breakdown", f"{V1} {REASONS}", conv=CONV, **REVIEW_TABLES)
def _(_conv, facts, src, labels):
    return R.reason_breakdown(_v1(facts, src, labels))


@query("review_categories", f"{V1} {CATEGORIES}", conv=CONV, **REVIEW_TABLES)
def _(_conv, facts, src, labels):
    return R.review_categories(_v1(facts, src, labels))


@query("conversion_mismatches", f"{V1} {MISMATCHES}", conv=CONV, **REVIEW_TABLES)
def _(_conv, facts, src, labels):
    return R.conversion_mismatches(_v1(facts, src, labels))


# ---- duplicates and evidence

MEMBERS = """SELECT i.sha256 AS grp, i.image_id, CASE WHEN k % 1009 = 0 THEN 'val' ELSE 'train' END AS split, coalesce(n, 0) AS object_count, concat(CAST(coalesce(n, 0) AS VARCHAR(9)), ':', CAST(k % 2 AS VARCHAR(9))) AS fingerprint, width, height, width AS xml_width, CAST(height + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS INT) AS xml_height,
 CAST(k % 31 AS INT) AS label_errors, CAST(0 AS BIGINT) AS zero, k FROM ({images_}) i LEFT JOIN (SELECT image_id AS id, count(*) AS n FROM ({boxes_}) b GROUP BY 1) c ON i.image_id = c.id WHERE i.readable""".replace("{images_}", V.IMAGES).replace("{boxes_}", V.BOXES)
MEMBERS = MEMBERS.replace("GROUP BY 1", "GROUP BY image_id")


@query("attach_duplicate_group", f"SELECT m.*, CASE WHEN g.sha256 IS NOT NULL THEN g.sha256 ELSE duplicate_group_id END AS \"group\" FROM (SELECT image_id, duplicate_group_id FROM m) m JOIN images i USING (image_id) LEFT JOIN ({GROUPS}) g ON g.sha256 = i.sha256", m=V.MANIFEST, images=V.IMAGES)
def _(m, images):
    return R.attach_duplicate_group(m.select("image_id", "duplicate_group_id"), images, A.duplicate_groups(images))


@query("fingerprint_groups", "SELECT grp AS \"group\", image_id, fingerprint, count(DISTINCT fingerprint) OVER (PARTITION BY grp) = 1 AS identical FROM mem", mem=MEMBERS)
def _(mem):
    return R.fingerprint_groups(mem.select(F.col("grp").alias("group"), "image_id", "fingerprint"))


@query("compare_duplicate_annotations", """SELECT grp AS "group", string_agg(image_id, ';' ORDER BY image_id) AS image_ids, list_sort(list(DISTINCT split)) AS splits, string_agg(image_id || ':' || object_count, ';' ORDER BY image_id) AS object_counts,
 string_agg(image_id || ':' || xml_width || ',' || xml_height, ';' ORDER BY image_id) AS xml_dimensions, string_agg(image_id || ':' || width || ',' || height, ';' ORDER BY image_id) AS image_dimensions, count(DISTINCT fingerprint) = 1 AS identical_annotations,
 count(DISTINCT (xml_width, xml_height)) = 1 AS xml_dimensions_consistent, count(DISTINCT (width, height)) = 1 AS image_dimensions_consistent, count(DISTINCT split) = 1 AS one_split FROM mem GROUP BY 1""", mem=MEMBERS)
def _(mem):
    out = R.compare_duplicate_annotations(mem.withColumnRenamed("grp", "group"))
    text = lambda c, of: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit(":"), of(e["value"]))), ";").alias(c)
    size = lambda v: F.array_join(v.cast("array<string>"), ",")
    return out.select("group", F.array_join("image_ids", ";").alias("image_ids"), "splits", text("object_counts", lambda v: v.cast("string")), text("xml_dimensions", size), text("image_dimensions", size), "identical_annotations", "xml_dimensions_consistent", "image_dimensions_consistent", "one_split")


@query("group_agreement", """SELECT grp AS "group", count(*) AS members, list_sort(list(DISTINCT split)) AS splits, count(DISTINCT fingerprint) = 1 AS identical_annotations, count(DISTINCT (xml_width, xml_height)) = 1 AS xml_dimensions_consistent,
 count(DISTINCT (width, height)) = 1 AS image_dimensions_consistent, count(DISTINCT split) = 1 AS one_split FROM mem GROUP BY 1""", mem=MEMBERS)
def _(mem):
    return R.group_agreement(mem.withColumnRenamed("grp", "group"))


@query("duplicate_group_texts", """SELECT grp AS "group", (r - 1) // 3 AS chunk_no, min(image_id) AS first_id, max(image_id) AS last_id, count(*)::INT AS members, string_agg(image_id, ';' ORDER BY image_id) AS image_ids, string_agg(image_id || ':' || object_count, ';' ORDER BY image_id) AS object_counts,
 string_agg(image_id || ':' || xml_width || ',' || xml_height, ';' ORDER BY image_id) AS xml_dimensions, string_agg(image_id || ':' || width || ',' || height, ';' ORDER BY image_id) AS image_dimensions FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY image_id) AS r FROM mem) GROUP BY 1, 2""", mem=MEMBERS)
def _(mem):
    return R.duplicate_group_texts(mem.withColumnRenamed("grp", "group"), 3)


def _baseline(mem):
    return R.group_baseline_compare(mem.select(F.col("grp").alias("group"), "image_id", "split", "fingerprint", "label_errors", F.col("object_count").alias("source_count"), F.col("object_count").alias("converted_count"), F.col("zero").alias("unmatched_source"), F.col("zero").alias("unmatched_converted"), F.lit(None).cast("double").alias("max_delta"), F.lit(None).cast("double").alias("min_iou")))


BASE = f"""b0 AS (SELECT grp AS "group", image_id, split, object_count AS source_count, object_count AS converted_count, fingerprint = first_value(fingerprint) OVER (PARTITION BY grp ORDER BY image_id) AS same_as_first, label_errors = 0 AS conversion_valid, NOT (label_errors = 0) OR (SELECT count(DISTINCT split) FROM mem x WHERE x.grp = mem.grp) <> 1 AS blocking FROM mem),
 b AS (SELECT *, CASE WHEN blocking THEN '{R.EXPLAIN_FAILED}' ELSE '{R.EXPLAIN_VALID.replace("'", "''")}' END AS explanation FROM b0)"""


@query("group_baseline_compare", f", {BASE} SELECT * FROM b", mem=MEMBERS)
def _(mem):
    return _baseline(mem)


@query("duplicate_review_rows", f", {BASE} SELECT *, (SELECT string_agg(x.image_id || ':' || x.source_count, ';' ORDER BY x.image_id) FROM b x WHERE x.\"group\" = b.\"group\") AS group_object_counts FROM b", mem=MEMBERS)
def _(mem):
    return R.with_group_object_counts(_baseline(mem))


@query("duplicate_review_summary", f", {BASE} SELECT count(DISTINCT \"group\") AS groups, count(*) AS images, bool_and(conversion_valid) AS all_valid, bool_and(NOT blocking) AS none_blocking FROM b", mem=MEMBERS)
def _(mem):
    return R.duplicate_review_summary(_baseline(mem))


#: Corners with fractions, very small and very large ones too.
FRACTIONS = "SELECT image_id, object_index, class_name, xmin / 7 AS xmin, ymin * 3001.25 AS ymin, xmax * 0.000001 AS xmax, ymax AS ymax FROM ({boxes_}) q".replace("{boxes_}", V.BOXES)
FINGER = "SELECT image_id, sha256(string_agg(class_name || ':' || printf('%g,%g,%g,%g', xmin, ymin, xmax, ymax), '|' ORDER BY object_index)) AS fingerprint FROM boxes GROUP BY 1"


@query("annotation_fingerprint", FINGER, boxes=FRACTIONS)
def _(boxes):
    return R.annotation_fingerprint(boxes)


_SPLITS = "(VALUES ('test'), ('train'), ('val')) t(s) LEFT JOIN vd ON split = s GROUP BY 2"
REPORT = f"""{V1}, ct AS ({CATEGORIES}), {BASE}, bs AS (SELECT * FROM b) SELECT 'status' AS metric, s AS key, count(vd.image_id) AS value FROM (VALUES ('PASS'), ('NEEDS_REVIEW'), ('REJECT')) t(s) LEFT JOIN vd ON status = s GROUP BY 2
 UNION ALL SELECT 'images_checked', '', count(*) FROM vd UNION ALL SELECT 'source_objects_checked', '', sum(source_count)::BIGINT FROM vd UNION ALL SELECT 'objects_checked', '', sum(converted_count)::BIGINT FROM vd
 UNION ALL SELECT 'split_images', s, count(vd.image_id) FROM {_SPLITS} UNION ALL SELECT 'split_objects', s, coalesce(sum(converted_count), 0)::BIGINT FROM {_SPLITS} UNION ALL SELECT 'split_source_objects', s, coalesce(sum(source_count), 0)::BIGINT FROM {_SPLITS}
 UNION ALL SELECT 'reason', reason, n FROM ({REASONS}) UNION ALL SELECT 'category', category, n FROM ct WHERE category <> 'both_reasons' UNION ALL SELECT 'both_reasons', '', coalesce(sum(n), 0)::BIGINT FROM ct WHERE category = 'both_reasons'
 UNION ALL SELECT 'conversion_mismatches', '', count(*) FROM ({MISMATCHES})
 UNION ALL SELECT 'groups_crossing_splits', '', count(*) FROM (SELECT duplicate_group_id FROM m WHERE duplicate_group_id <> '' GROUP BY 1 HAVING count(DISTINCT split) > 1)
 UNION ALL SELECT 'groups_with_differing_counts', '', count(*) FROM (SELECT duplicate_group_id FROM m WHERE duplicate_group_id <> '' GROUP BY 1 HAVING count(DISTINCT object_count) > 1)
 UNION ALL SELECT 'filenames_in_multiple_splits', '', count(*) FROM facts WHERE in_several_splits
 UNION ALL SELECT 'absolute_paths', '', count(*) FROM m WHERE source_image_path LIKE '/%' UNION ALL SELECT 'duplicate_hash_groups', '', count(*) FROM ({GROUPS}) UNION ALL SELECT 'unreadable_source_hashes', '', count(*) FROM images WHERE NOT readable
 UNION ALL SELECT 'duplicate_reviews', '', count(*) FROM bs UNION ALL SELECT 'duplicate_reviews_blocking', '', count(*) FROM bs WHERE blocking"""


@query("readiness_report", REPORT, conv=CONV, m=V.MANIFEST, images=V.IMAGES, mem=MEMBERS, **REVIEW_TABLES)
def _(_conv, m, images, mem, facts, src, labels):
    compared = _baseline(mem)
    reviews = written(_v1(facts, src, labels).select("status", "reasons", "split", "source_count", "converted_count"), "reviews")
    freed(m.sparkSession)
    return R.readiness_report(reviews, {
        "groups_crossing_splits": Q.split_leaks(m, {"group": "duplicate_group_id"}), "groups_with_differing_counts": Q.duplicate_count_differs(m), "filenames_in_multiple_splits": facts.where("in_several_splits"),
        "absolute_paths": Q.absolute_manifest_paths(m), "duplicate_hash_groups": A.duplicate_groups(images), "unreadable_source_hashes": images.where("not readable"),
        "duplicate_reviews": compared, "duplicate_reviews_blocking": compared.where("blocking"),
    })


PREVIEWS = "SELECT CASE WHEN k % 97 = 0 THEN concat('gone_', image_id) ELSE image_id END AS image_id, CASE WHEN k % 89 = 0 THEN 'other' ELSE split END AS split FROM (" + V.MANIFEST + ") m"
VERDICTS = "SELECT image_id, CASE WHEN k % 3 = 0 THEN 'Pass' ELSE 'Needs review' END AS status, CASE WHEN k % 3 = 0 THEN '' ELSE 'contains_very_small_box' END AS reasons FROM (" + V.IMAGES + ") i"


@query("join_previews", """SELECT p.image_id, p.split, CASE WHEN m.image_id IS NULL OR m.split <> p.split THEN 'Reject' ELSE status END AS status, CASE WHEN m.image_id IS NULL THEN 'missing_manifest_record' WHEN m.split <> p.split THEN concat_ws(';', nullif(v.reasons, ''), 'preview_and_manifest_split_differ') ELSE v.reasons END AS reasons
 FROM p LEFT JOIN m ON m.image_id = p.image_id LEFT JOIN v ON v.image_id = p.image_id""", p=PREVIEWS, v=VERDICTS, m=V.MANIFEST)
def _(p, v, m):
    out = R.join_previews(p, v.withColumn("reasons", S.split_reasons(F.col("reasons"))), m)
    return out.withColumn("reasons", S.reasons_text(F.col("reasons")))


#: An earlier review of all images, some of which have other ids now.
PREVIOUS = "SELECT CASE WHEN k % 4 = 0 THEN image_id ELSE concat('old_', image_id) END AS image_id, CASE WHEN k % 2 = 0 THEN 'approved' ELSE '' END AS review_status, concat('note ', CAST(k AS VARCHAR(20))) AS reviewer_notes FROM (" + V.IMAGES + ") i"


@query("preserve_human_fields", "SELECT v.image_id, v.status, coalesce(q.review_status, '') AS review_status, coalesce(q.reviewer_notes, '') AS reviewer_notes FROM v LEFT JOIN q ON q.image_id = v.image_id", v=VERDICTS, q=PREVIOUS)
def _(v, q):
    return R.preserve_human_fields(v.select("image_id", "status"), q)


# ---- samples

RISK = f"SELECT i.image_id, CAST(coalesce(n, 0) AS BIGINT) AS object_count, CAST(coalesce(s, 0) AS BIGINT) AS small_box_count, largest_area, largest_aspect FROM ({V.IMAGES}) i LEFT JOIN (SELECT image_id AS id, count(*) AS n, sum(CASE WHEN {SMALL} THEN 1 ELSE 0 END) AS s, max((xmax - xmin) * (ymax - ymin)) AS largest_area, max(greatest((xmax - xmin) / (ymax - ymin), (ymax - ymin) / (xmax - xmin))) AS largest_aspect FROM ({V.SOURCE}) b GROUP BY image_id) c ON i.image_id = c.id"
TOP = " UNION ALL ".join(f"SELECT {i} AS rule_no, image_id, '{r}' AS reason, rank FROM (SELECT image_id, {c} AS v, row_number() OVER (ORDER BY {c} DESC NULLS LAST, image_id)::INT AS rank FROM risk) WHERE rank <= {k}{' AND v > 0' if pos else ''}" for i, (r, c, k, pos) in enumerate(P.RISK_RULES))


@query("top_by_risk", TOP, risk=RISK)
def _(risk):
    return P.top_by_risk(risk)


GROUPED = "SELECT image_id, duplicate_group_id AS grp FROM (" + V.MANIFEST + ") m"


@query("duplicate_members", "SELECT image_id, grp AS \"group\", 'duplicate_group:' || substr(grp, 1, 12) AS reason FROM g WHERE grp <> ''", g=GROUPED)
def _(g):
    return P.duplicate_members(g.withColumnRenamed("grp", "group"))


@query("duplicate_members_first", "SELECT image_id, grp AS \"group\", 'duplicate_group:' || substr(grp, 1, 12) AS reason FROM g WHERE grp <> '' ORDER BY grp, image_id LIMIT 12", g=GROUPED)
def _(g):
    return P.duplicate_members(g.withColumnRenamed("grp", "group"), 12)


LISTS = "SELECT concat('list_', CAST(k % 5 AS VARCHAR(9))) AS list_name, image_id FROM (" + V.IMAGES + ") i UNION ALL SELECT concat('list_', CAST((k + 1) % 5 AS VARCHAR(9))) AS list_name, image_id FROM (" + V.IMAGES + ") i"


@query("split_list_representatives", """, n AS (SELECT list_name, row_number() OVER (ORDER BY list_name) AS i FROM (SELECT DISTINCT list_name FROM lists)),
 p1 AS (SELECT 1 AS i, min(image_id) AS p FROM lists JOIN n USING (list_name) WHERE i = 1),
 p2 AS (SELECT 2 AS i, min(image_id) AS p FROM lists JOIN n USING (list_name) WHERE n.i = 2 AND image_id NOT IN (SELECT p FROM p1)),
 p3 AS (SELECT 3 AS i, min(image_id) AS p FROM lists JOIN n USING (list_name) WHERE n.i = 3 AND image_id NOT IN (SELECT p FROM p1 UNION ALL SELECT p FROM p2)),
 p4 AS (SELECT 4 AS i, min(image_id) AS p FROM lists JOIN n USING (list_name) WHERE n.i = 4 AND image_id NOT IN (SELECT p FROM p1 UNION ALL SELECT p FROM p2 UNION ALL SELECT p FROM p3)),
 p5 AS (SELECT 5 AS i, min(image_id) AS p FROM lists JOIN n USING (list_name) WHERE n.i = 5 AND image_id NOT IN (SELECT p FROM p1 UNION ALL SELECT p FROM p2 UNION ALL SELECT p FROM p3 UNION ALL SELECT p FROM p4))
 SELECT list_name, p AS image_id FROM n JOIN (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4 UNION ALL SELECT * FROM p5) USING (i)""", lists=LISTS)
def _(lists):
    return P.split_list_representatives(lists)


QUOTA = {"train": 4, "val": 3, "test": 3}
SEEDED = "SELECT image_id, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('42:' || image_id), image_id) AS r FROM rows_) WHERE r <= CASE split WHEN 'train' THEN 4 WHEN 'val' THEN 3 WHEN 'test' THEN 3 ELSE 0 END"


PASSED = ", rows_ AS (SELECT image_id, split FROM vd WHERE status = 'PASS')"


def _passed(facts, src, labels):
    return written(_v1(facts, src, labels).where(F.col("status") == R.PASS).select("image_id", "split"), "passed")


@query("seeded_sample_per_split", f"{V1}{PASSED} {SEEDED}", conv=CONV, **REVIEW_TABLES)
def _(_conv, facts, src, labels):
    return P.seeded_sample_per_split(_passed(facts, src, labels), QUOTA, 42, strict=True).select("image_id", "split")


@query("fill_sample", f"{V1}{PASSED}, sel AS ({SEEDED}) SELECT image_id, split FROM rows_ WHERE image_id NOT IN (SELECT image_id FROM sel) ORDER BY md5('7:' || image_id), image_id LIMIT 50", conv=CONV, **REVIEW_TABLES)
def _(_conv, facts, src, labels):
    rows = _passed(facts, src, labels)
    return P.fill_sample(rows, P.seeded_sample_per_split(rows, QUOTA, 42), 60, 7)


@query("combine_sample_reasons", f", picks AS ({TOP}), f AS (SELECT image_id, reason, min((rule_no, rank)) AS f FROM picks GROUP BY 1, 2), c AS (SELECT image_id, string_agg(reason, ';' ORDER BY f) AS reasons, min(f) AS g FROM f GROUP BY 1) SELECT image_id, reasons FROM (SELECT * FROM c ORDER BY g, image_id LIMIT 20)", risk=RISK)
def _(risk):
    out = P.combine_sample_reasons(P.top_by_risk(risk), 20)
    return out.withColumn("reasons", S.reasons_text(F.col("reasons")))


# ---- splits

ITEMS = "SELECT image_id, object_count, small_box_count, duplicate_group_id FROM (" + V.MANIFEST + ") m"
KEYED = "it AS (SELECT *, CASE WHEN duplicate_group_id = '' THEN 'single:' || image_id ELSE duplicate_group_id END AS key FROM items), gr AS (SELECT key, count(*) AS images, sum(object_count)::BIGINT AS objects, sum(small_box_count)::BIGINT AS small FROM it GROUP BY 1)"


@query("form_split_groups", f", {KEYED} SELECT * FROM gr", items=ITEMS)
def _(items):
    return G.form_split_groups(items)


def _greedy_sql() -> str:
    """The greedy rule group by group: each to the split that is used least, ties by name."""
    splits = sorted(RATIOS)
    held = [f"{c}_{s}" for s in splits for c in ("i", "o", "s")]
    used = {s: f"4.0::DOUBLE * f.i_{s} / greatest(t.i * {RATIOS[s]}::DOUBLE, 1) + f.o_{s} / greatest(t.o * {RATIOS[s]}::DOUBLE, 1) + f.s_{s} / greatest(t.s * {RATIOS[s]}::DOUBLE, 1)" for s in splits}
    pick = "CASE WHEN u_test <= u_train AND u_test <= u_val THEN 'test' WHEN u_train <= u_val THEN 'train' ELSE 'val' END"
    step = ", ".join(f"{c}_{s} + CASE WHEN pick = '{s}' THEN d{c} ELSE 0 END" for s in splits for c in ("i", "o", "s"))
    return f"""RECURSIVE , {KEYED}, o AS (SELECT *, row_number() OVER (ORDER BY objects DESC, images DESC, small DESC, key) AS n FROM gr), t AS (SELECT sum(images)::DOUBLE AS i, sum(objects)::DOUBLE AS o, sum(small)::DOUBLE AS s FROM gr),
 f AS (SELECT 0::BIGINT AS n, '' AS pick, {", ".join(f"0::BIGINT AS {h}" for h in held)}
  UNION ALL SELECT n, pick, {step} FROM (SELECT *, {pick} AS pick FROM (SELECT f.* EXCLUDE (n, pick), o.n, o.images AS di, o.objects AS do_, o.small AS ds, {", ".join(f"{u} AS u_{s}" for s, u in used.items())} FROM f JOIN o ON o.n = f.n + 1, t)))
 SELECT image_id, pick AS split FROM it JOIN o USING (key) JOIN (SELECT n, pick FROM f) USING (n)""".replace("THEN do ELSE", "THEN do_ ELSE")


@query("assign_splits", _greedy_sql(), items=ITEMS)
def _(items):
    return G.assign_splits(items, RATIOS)


@query("assign_splits_hash", f", {KEYED} SELECT image_id, CASE WHEN u < 0.15 THEN 'test' WHEN u < 0.85 THEN 'train' ELSE 'val' END AS split FROM (SELECT image_id, ('0x' || substr(md5('42:' || key), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM it)", items=ITEMS)
def _(items):
    return G.assign_splits_hash(items, RATIOS)


@query("assign_splits_stratified", f", {KEYED}, r AS (SELECT key, (row_number() OVER (PARTITION BY objects, images, small ORDER BY md5('42:' || key), key) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY objects, images, small) AS u FROM gr) SELECT image_id, CASE WHEN u < 0.15 THEN 'test' WHEN u < 0.85 THEN 'train' ELSE 'val' END AS split FROM it JOIN r USING (key)", items=ITEMS)
def _(items):
    return G.assign_splits_stratified(items, RATIOS)


ASSIGNED = "SELECT image_id, split FROM (" + V.MANIFEST + ") m WHERE k % 641 <> 0"


@query("split_violations", f", {KEYED} SELECT 'unassigned' AS kind, image_id AS key FROM items WHERE image_id NOT IN (SELECT image_id FROM a) UNION ALL SELECT 'group crosses splits', key FROM it JOIN a USING (image_id) GROUP BY key HAVING count(DISTINCT split) > 1", items=ITEMS, a=ASSIGNED)
def _(items, a):
    return G.split_violations(items, a)


# ---- metrics

BEST = "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN map50 <> 0 THEN map50 END DESC NULLS LAST, epoch) AS n FROM e) WHERE n = 1"


@query("best_epoch", BEST, e=V.EPOCHS)
def _(e):
    return X.best_epoch(e, "map50")


@query("last_epoch", "SELECT run, max(epoch) AS last_epoch, arg_min(loss, epoch) AS loss_first, arg_max(loss, epoch) AS loss_last, arg_max(loss, epoch) - arg_min(loss, epoch) AS loss_change FROM e GROUP BY 1", e=V.EPOCHS)
def _(e):
    return X.last_epoch(e, ["loss"])


ODD = V.EPOCHS.replace("value * 2 AS loss", "CASE WHEN epoch % 101 = 0 THEN CAST('NaN' AS DOUBLE) WHEN epoch % 103 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS loss")


@query("finite_metrics_check", "SELECT run, count(*) AS epochs, max(epoch) AS last_epoch, count(*) FILTER (WHERE isnan(loss) OR isinf(loss)) AS not_finite, count(*) = 2000 AND max(epoch) = 2000 AS complete FROM e GROUP BY 1", e=ODD)
def _(e):
    return X.finite_metrics_check(e, ["map50", "loss"], 2000)


@query("run_comparison", f", b AS ({BEST}), x AS (SELECT run, unnest(['map50', 'loss']) AS metric, unnest([map50, loss]) AS v FROM b) SELECT p.metric, p.v AS base, q.v AS other, round(q.v - p.v, 9) AS change, round((q.v - p.v) / p.v * 100, 6) AS change_percent FROM x p JOIN x q USING (metric) WHERE p.run = (SELECT min(run) FROM e) AND q.run = (SELECT max(run) FROM e)", e=V.EPOCHS)
def _(e):
    runs = e.agg(F.min("run").alias("a"), F.max("run").alias("b")).first()
    out = X.run_comparison(X.best_epoch(e, "map50"), runs["a"], runs["b"], ["map50", "loss"])
    return out.withColumn("change", F.round("change", 9)).withColumn("change_percent", F.round("change_percent", 6))


VALUES = "SELECT run AS metric, max(map50) AS first_value, max(loss) AS second_value FROM (" + V.EPOCHS + ") e GROUP BY run"


@query("generalisation_gap", "SELECT metric, first_value AS first, second_value AS second, second_value - first_value AS change, round((second_value - first_value) / first_value * 100, 6) AS change_percent FROM v", v=VALUES)
def _(v):
    out = X.generalisation_gap(v.select("metric", F.col("first_value").alias("value")), v.select("metric", F.col("second_value").alias("value")))
    return out.withColumn("change_percent", F.round("change_percent", 6))


RUNS = "SELECT run, CAST(sum(epoch % 1000) AS DOUBLE) AS seconds, count(*) AS epochs FROM (" + V.EPOCHS + ") e GROUP BY run"


@query("seconds_per_epoch", "SELECT run, seconds, epochs, seconds / epochs AS seconds_per_epoch, round((seconds / epochs / (SELECT min(seconds / epochs) FROM r) - 1) * 100, 6) AS percent_slower FROM r", r=RUNS)
def _(r):
    return X.seconds_per_epoch(r).withColumn("percent_slower", F.round("percent_slower", 6))


DET = """RECURSIVE , pr AS (SELECT p.image_id, p.pred_id, p.confidence, s.truth_id, i / ((s.xmax - s.xmin) * (s.ymax - s.ymin) + (p.xmax - p.xmin) * (p.ymax - p.ymin) - i) AS iou FROM
  (SELECT d.image_id, d.pred_id, d.confidence, s.truth_id, {iou} AS i FROM pred d JOIN tr s ON s.image_id = d.image_id) z JOIN pred p USING (image_id, pred_id) JOIN tr s ON s.image_id = z.image_id AND s.truth_id = z.truth_id WHERE i > 0),
 th AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS threshold),
 od AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, pred_id) AS n FROM (SELECT image_id, pred_id, confidence, list({'u': iou, 't': truth_id} ORDER BY iou DESC, truth_id DESC) AS c FROM pr WHERE iou >= 0.5 GROUP BY 1, 2, 3)),
 fo AS (SELECT image_id, threshold, 0::BIGINT AS n, []::INT[] AS used, NULL::INT AS pid, NULL::INT AS got FROM (SELECT DISTINCT image_id FROM od), th
  UNION ALL SELECT f.image_id, f.threshold, o.n, CASE WHEN g IS NULL THEN used ELSE list_append(used, g) END, o.pred_id, g FROM (SELECT f.image_id, f.threshold, o.n, f.used, o.pred_id, list_filter(o.c, lambda x: x.u >= f.threshold AND NOT list_contains(f.used, x.t))[1].t AS g FROM fo f JOIN od o ON o.image_id = f.image_id AND o.n = f.n + 1) f JOIN od o ON o.image_id = f.image_id AND o.n = f.n),
 mh AS (SELECT p.image_id, p.pred_id, p.confidence, th.threshold, coalesce(f.got IS NOT NULL, FALSE) AS hit FROM pred p CROSS JOIN th LEFT JOIN fo f ON f.image_id = p.image_id AND f.threshold = th.threshold AND f.pid = p.pred_id)""".replace("{iou}", IOU)
CURVE = f"""{DET}, pt AS (SELECT threshold, confidence, count(*) FILTER (WHERE hit) AS t, count(*) FILTER (WHERE NOT hit) AS f FROM mh GROUP BY 1, 2),
 cu AS (SELECT 0 AS class_id, threshold, confidence, sum(t) OVER w::BIGINT AS tp, sum(f) OVER w::BIGINT AS fp FROM pt WINDOW w AS (PARTITION BY threshold ORDER BY confidence DESC)),
 cv AS (SELECT *, tp / (tp + fp) AS precision, tp / (SELECT count(*) FROM tr) AS recall FROM cu)""".replace("sum(t) OVER w::BIGINT", "CAST(sum(t) OVER w AS BIGINT)").replace("sum(f) OVER w::BIGINT", "CAST(sum(f) OVER w AS BIGINT)")
DETECT = {"pred": V.PREDICTIONS, "tr": V.TRUTH}


@query("match_predictions", f"{DET} SELECT image_id, 0 AS class_id, pred_id, confidence, threshold, hit FROM mh", **DETECT)
def _(pred, tr):
    return X.match_predictions(pred, tr).select("image_id", "class_id", "pred_id", "confidence", "threshold", "hit")


@query("precision_recall", f"{CURVE} SELECT class_id, threshold, confidence, tp, fp, precision, recall FROM cv", **DETECT)
def _(pred, tr):
    return X.precision_recall_of_masks(X.match_masks(pred, tr), tr)


AP = f"{CURVE}, gp AS (SELECT threshold, r, coalesce(max(precision), 0) AS p FROM (SELECT DISTINCT threshold FROM cv) CROSS JOIN (SELECT unnest(range(101)) AS r) LEFT JOIN cv USING (threshold) WHERE floor(recall * 100 + 1e-9) >= r GROUP BY 1, 2), ap AS (SELECT 0 AS class_id, threshold, sum(p) / 101 AS ap FROM gp GROUP BY 2)"


@query("average_precision", f"{AP} SELECT class_id, threshold, round(ap, 9) AS ap FROM ap", **DETECT)
def _(pred, tr):
    return X.average_precision(X.precision_recall_of_masks(X.match_masks(pred, tr), tr)).withColumn("ap", F.round("ap", 9))


@query("detection_metrics", f"{AP} SELECT 0 AS class_id, round(x.precision, 9) AS precision, round(x.recall, 9) AS recall, round((SELECT ap FROM ap WHERE threshold = 0.5), 9) AS map50, round((SELECT avg(ap) FROM ap), 9) AS map50_95 FROM (SELECT * FROM cv WHERE threshold = 0.5 ORDER BY CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END DESC, confidence DESC LIMIT 1) x", **DETECT)
def _(pred, tr):
    out = X.detection_metrics(pred, tr)
    return out.select("class_id", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "map50", "map50_95")])


@query("confusion_counts", f"{DET} SELECT count(*) FILTER (WHERE hit) AS matched, count(*) FILTER (WHERE NOT hit) AS background, (SELECT count(*) FROM tr) - count(*) FILTER (WHERE hit) AS missed FROM (SELECT * FROM mh WHERE threshold = 0.5 AND confidence >= 0.25)", **DETECT)
def _(pred, tr):
    return X.confusion_counts(pred, tr, 0.25)


# ---- file rows that need no files: texts of annotations and labels made from the tables

XML = f"""SELECT concat('xml/', image_id, '.xml') AS path, concat('<annotation><filename>', image_id, '.jpg</filename><size><width>', CAST(max(width) AS VARCHAR(9)), '</width><height>', CAST(max(height) AS VARCHAR(9)), '</height></size>',
 '<object><name>fore</name><bndbox><xmin>', CAST(CAST(min(xmin) AS BIGINT) AS VARCHAR(9)), '</xmin><ymin>1</ymin><xmax>', CAST(CAST(max(xmax) AS BIGINT) AS VARCHAR(9)), '</xmax><ymax>9</ymax></bndbox></object></annotation>') AS value,
 CAST(min(xmin) AS BIGINT) AS x0, CAST(max(xmax) AS BIGINT) AS x1, image_id, max(width) AS width, max(height) AS height FROM ({V.SOURCE}) s GROUP BY image_id"""


@query("parse_annotations", "SELECT path AS xml_path, image_id, 1 AS object_index, 'fore' AS class_name, TRUE AS has_box, x0::VARCHAR AS xmin, '1' AS ymin, x1::VARCHAR AS xmax, '9' AS ymax, width::VARCHAR AS xml_width, height::VARCHAR AS xml_height FROM x", x=XML)
def _(x):
    return IO.explode_boxes(IO.parse_annotations(x.select("path", "value")))


LINES = "SELECT CAST(conv_id AS VARCHAR(20)) AS path, text AS value, conv_id, turn FROM {conversations}"


@query("label_rows", "SELECT path, line_no, line, len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+'))::INT AS n FROM (SELECT path, unnest(string_split_regex(v, '\\r\\n|\\n|\\r')) AS line, generate_subscripts(string_split_regex(v, '\\r\\n|\\n|\\r'), 1)::INT AS line_no FROM (SELECT path, regexp_replace(value, '(\\r\\n|\\r|\\n)$', '') AS v FROM x WHERE value <> ''))", x=LINES)
def _(x):
    return IO.label_rows(x.select("path", "value")).select("path", "line_no", "line", F.size("tokens").alias("n"))


def _image_bytes(images):
    """Images of eight kinds as bytes, made of sizes and numbers: whole ones, ones broken off after 20 bytes, PNGs with a
    wrong checksum, JPEGs whose frame stands behind segments that hold frames of other sizes."""
    digits = lambda x, n: F.lpad(F.hex(x), 2 * n, "0")
    w, h, k = F.col("width"), F.col("height"), F.col("k")
    little = lambda x, n: F.concat(*[digits(F.shiftright(x, 8 * i).bitwiseAND(F.lit(255)), 1) for i in range(n)])
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def chunk(kind: str, data):
        body = text(kind.encode().hex(), data)
        return text(digits((F.length(data) / 2).cast("int"), 4), body, digits(F.crc32(F.unhex(body)) + F.when(k % 89 == 0, 1).otherwise(0), 4))

    decoys = F.repeat(F.lit("FFC00011080001000103"), (k % 997).cast("int"))
    kinds = [
        text("89504E470D0A1A0A", chunk("IHDR", text(digits(w, 4), digits(h, 4), "0802000000")), chunk("IDAT", F.lit("00")), "0000000049454E44AE426082"),
        text("FFD8FFE000104A46494600010101004800480000FFE1", digits((F.length(decoys) / 2).cast("int") + 2, 2), decoys, "FFFFC2001108", digits(h, 2), digits(w, 2), "03012200021101031101FFDA0002"),
        text("474946383961", little(w - 1, 2), little(h, 2), "800000", "000000FFFFFF", "21F9040000000000", "2C00000000", little(w, 2), little(h, 2), "00"),
        text("424D00000000000000003600000028000000", little(w, 4), little(-h, 4), "0100180000000000"),
        text("49492A0008000000", "0200", "0001030001000000", little(w, 4), "0101030001000000", little(h, 4), "00000000"),
        text("4D4D002A00000010", "0000000000000000", "0003", "00FE00040000000100000000", "0100000400000001", digits(w, 4), "0101000400000001", digits(h, 4)),
        text("52494646000000005745425056503858", "0A00000000000000", little(w - 1, 3), little(h - 1, 3)),
        text("5249464600000000574542505650384C", "050000002F", little((w - 1).bitwiseOR(F.shiftleft(h - 1, 14)), 4)),
    ]
    whole = F.element_at(F.array(*kinds), (k % len(kinds) + 1).cast("int"))
    return images.select("path", F.unhex(F.when(F.col("readable"), whole).otherwise(F.substring(whole, 1, 40))).alias("content"))


@query("image_facts", """SELECT path, CASE WHEN ok THEN (['png', 'jpeg', 'gif', 'bmp', 'tiff', 'tiff', 'webp', 'webp'])[k % 8 + 1] END AS format, CASE WHEN ok THEN width::BIGINT END AS width, CASE WHEN ok THEN height::BIGINT END AS height, ok AS readable
 FROM (SELECT *, readable AND NOT (k % 8 = 0 AND k % 89 = 0) AS ok FROM images)""", images=V.IMAGES)
def _(images):
    return IO.header_facts(_image_bytes(images)).drop("sha256")


# ---- round trips: what the sinks write below the shared folder and the sources read again

@query("manifest_round_trip", "SELECT image_id, split, image_path, label_path, source_image_path, source_xml_path, width::VARCHAR AS image_width, height::VARCHAR AS image_height, object_count::VARCHAR AS object_count, small_box_count::VARCHAR AS small_box_count, duplicate_group_id FROM m JOIN (SELECT image_id, width, height FROM images) i USING (image_id)", m=V.MANIFEST, images=V.IMAGES)
def _(m, images):
    path = new_path(m.sparkSession, "manifest")
    K.write_manifest(m.join(images.select("image_id", F.col("width").alias("image_width"), F.col("height").alias("image_height")), "image_id"), path)
    return IO.read_manifest(m.sparkSession, path, ("image_id", "split"))


@query("labels_round_trip", """SELECT m.image_id, m.split, coalesce(t, '') AS label_text, coalesce(n, 0) AS n_rows FROM m LEFT JOIN (SELECT image_id, string_agg(printf('%d %.17g %.17g %.17g %.17g', class_id, xc, yc, w, h) || chr(10), '' ORDER BY line_no) AS t, count(*) AS n FROM labels GROUP BY 1) l ON l.image_id = m.image_id""", m=V.MANIFEST, labels=V.LABELS)
def _(m, labels):
    path = new_path(m.sparkSession, "labels")
    K.write_labels(labels, m, path)
    texts = m.sparkSession.read.parquet(path).select("image_id", "split", "label_text")
    rows = IO.label_boxes(IO.label_rows(texts, "image_id", "label_text")).where("n_values = 5 and class_id is not null and h is not null").groupBy(F.col("path").alias("image_id")).agg(F.count("*").alias("n"))
    return texts.join(rows, "image_id", "left").select("image_id", "split", "label_text", F.coalesce("n", F.lit(0)).alias("n_rows"))


@query("audit_report_round_trip", f"SELECT image_id, path, sha256 AS duplicate_group_id FROM images WHERE readable AND sha256 IN (SELECT sha256 FROM ({GROUPS}))", images=V.IMAGES, ann=V.ANNOTATIONS, boxes=V.BOXES)
def _(images, ann, boxes):
    path = new_path(images.sparkSession, "report")
    findings = written(audit_findings(images, ann, boxes), "findings")
    K.write_audit_report(findings, A.audit_summary(findings, images, ann, boxes, 10.0), path)
    return IO.read_audit_duplicates(images.sparkSession, path, images.select("image_id", "path"), lines=True)


def _files(images):
    """A folder of files of some bytes each, named by images; one file for each shard of images."""
    path = new_path(images.sparkSession, "files")
    rows = images.select((F.col("k") % 16).alias("shard"), F.concat_ws(" ", "image_id", "k").alias("value"))
    rows.repartition("shard").sortWithinPartitions("shard", "value").write.partitionBy("shard").text(path)
    return path


@query("read_split_lists", "SELECT concat('part_', CAST(k % 16 AS VARCHAR(9))) AS list_name, image_id FROM images", images=V.IMAGES)
def _(images):
    found = IO.read_split_lists(images.sparkSession, _files(images) + "/*")
    # the writer names its files; the folder holds the list's number
    return found.select(F.concat(F.lit("part_"), F.regexp_extract("list_path", "shard=([0-9]+)/", 1)).alias("list_name"), "image_id")


@query("provenance", "SELECT concat('part_', CAST(k % 16 AS VARCHAR(9))) AS part, sum(length(image_id) + length(CAST(k AS VARCHAR)) + 2)::BIGINT AS length, sha256(string_agg(image_id || ' ' || k || chr(10), '' ORDER BY image_id || ' ' || k)) AS sha256 FROM images GROUP BY 1", images=V.IMAGES)
def _(images):
    found = IO.provenance(images.sparkSession, [_files(images) + "/*"])
    return found.select(F.concat(F.lit("part_"), F.regexp_extract("path", "shard=([0-9]+)/", 1)).alias("part"), "length", "sha256")


@query("scan_images", "SELECT DISTINCT 'part_' || (k % 16) AS part, 'txt' AS suffix, TRUE AS has_bytes FROM images", images=V.IMAGES)
def _(images):
    found = IO.scan_images(images.sparkSession, _files(images), ("txt",))
    return found.select(F.concat(F.lit("part_"), F.regexp_extract("path", "shard=([0-9]+)/", 1)).alias("part"), "suffix", (F.col("length") > 0).alias("has_bytes"))


@query("findings_round_trip", f"""SELECT category, path, detail FROM (SELECT 'invalid_boxes' AS category, image_id AS path, {PROBLEMS} AS detail FROM boxes WHERE NOT ({VALID})
 UNION ALL SELECT 'corrupt_images', path, 'image cannot be read' FROM images WHERE NOT readable)""", boxes=V.BOXES, images=V.IMAGES)
def _(boxes, images):
    path = new_path(boxes.sparkSession, "findings")
    K.write_findings(A.union([A.find_invalid_boxes(boxes), A.find_corrupt_images(images)]), path)
    return A.union([boxes.sparkSession.read.schema("path string, detail string").csv(f"{path}/{c}", header=True).select(F.lit(c).alias("category"), "path", "detail") for c in A.FINDING_CATEGORIES])


@query("reviews_round_trip", f"""{V1} SELECT image_id, split, source_image_path, source_xml_path, label_path AS yolo_label_path, grp AS duplicate_group_id, source_count::VARCHAR AS source_object_count, status AS automated_status, array_to_string(reasons, ';') AS automated_reasons,
 coalesce(printf('%.6f', max_delta), '') AS max_coordinate_delta_px, coalesce(printf('%.6f', min_iou), '') AS minimum_matched_iou FROM vd JOIN (SELECT image_id, source_image_path, source_xml_path, label_path, grp FROM facts) USING (image_id) WHERE status <> 'PASS'""", conv=CONV, **REVIEW_TABLES)
def _(_conv, facts, src, labels):
    path = new_path(facts.sparkSession, "reviews")
    K.write_reviews(_v1(facts, src, labels), path, compression="gzip")
    rows = [facts.sparkSession.read.csv(f"{path}/{part}", header=True) for part in ("needs_review", "rejected")]
    assert rows[0].columns == list(K.REVIEW_COLUMNS)
    names = ("image_id", "split", "source_image_path", "source_xml_path", "yolo_label_path", "duplicate_group_id", "source_object_count", "automated_status", "automated_reasons", "max_coordinate_delta_px", "minimum_matched_iou")
    return rows[0].unionByName(rows[1]).select(*[F.coalesce(c, F.lit("")).alias(c) for c in names])


@query("epochs_round_trip", "SELECT epoch, map50 FROM e", e=V.EPOCHS)
def _(e):
    path = new_path(e.sparkSession, "epochs")
    e.select("epoch", F.coalesce(F.col("map50").cast("string"), F.lit("n/a")).alias("metrics/mAP50(B)")).write.csv(path, header=True)
    return IO.read_epoch_results(e.sparkSession, path, {"map50": ("mAP50", "metrics/mAP50(B)")})


@query("previous_review_round_trip", "SELECT image_id, review_status, reviewer_notes FROM q", q=PREVIOUS)
def _(q):
    path = new_path(q.sparkSession, "previous")
    q.write.csv(path, header=True)
    return IO.read_previous_review(q.sparkSession, path)


@query("summary_round_trip", "SELECT split, count(*) AS images FROM m GROUP BY 1", m=V.MANIFEST)
def _(m):
    path = new_path(m.sparkSession, "summary")
    K.write_summary(m.groupBy("split").agg(F.count("*").alias("images")), path)
    return m.sparkSession.read.schema("split string, images long").json(path)
