"""Image and box tables derived from general order tables, so that every operator can be run and checked on them.

One text per view serves both engines: {orders} and the like stand for the tables, {sha} and {end} for the digest.
"""

from pyspark.sql import DataFrame, SparkSession

IMAGES = """SELECT concat('img_', o_orderkey) AS image_id, CAST(640 + 64 * (o_orderkey % 9) AS INT) AS width, CAST(480 + 48 * (o_orderkey % 7) AS INT) AS height,
  concat('images/img_', o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN '.png' ELSE '.jpg' END) AS path, o_orderkey % 997 <> 0 AS readable,
  {sha}concat(o_custkey, '|', o_orderstatus, '|', o_orderpriority){end} AS sha256, o_orderkey AS k FROM {orders}"""

ANNOTATIONS = """SELECT concat('xml/img_', o_orderkey, '.xml') AS path, CASE WHEN o_orderkey % 1499 = 0 THEN 'broken' END AS parse_error,
  CASE WHEN o_orderkey % 503 = 0 THEN '' ELSE concat('img_', CASE WHEN o_orderkey % 709 = 0 THEN -o_orderkey ELSE o_orderkey END, '.jpg') END AS filename,
  CASE WHEN o_orderkey % 1006 = 0 THEN concat('old/img_', o_orderkey, '.jpg') ELSE '' END AS ref_path,
  CASE WHEN o_orderkey % 401 = 0 THEN NULL ELSE CAST(640 + 64 * (o_orderkey % 9) AS INT) END AS width, CAST(480 + 48 * (o_orderkey % 7) AS INT) AS height,
  concat('img_', o_orderkey) AS image_id FROM {orders}"""

BOXES = """SELECT concat('img_', l_orderkey) AS image_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS object_index,
  CASE l_partkey % 211 WHEN 0 THEN '' WHEN 1 THEN 'other' ELSE 'fore' END AS class_name,
  CAST(l_partkey * 37 % 620 AS DOUBLE) - 2.0 AS xmin, CAST(l_suppkey * 53 % 470 AS DOUBLE) AS ymin,
  CAST(l_partkey * 37 % 620 AS DOUBLE) - 3.0 + l_partkey % 48 AS xmax, CAST(l_suppkey * 53 % 470 AS DOUBLE) + l_linenumber * 6.0 + (l_suppkey % 5) + 2 AS ymax,
  CAST(640 + 64 * (l_orderkey % 9) AS INT) AS width, CAST(480 + 48 * (l_orderkey % 7) AS INT) AS height,
  l_partkey AS pk, l_suppkey AS sk, CAST(round(l_discount * 100) AS INT) AS disc, CAST(round(l_tax * 100) AS INT) AS tax, l_returnflag AS flag FROM {lineitem}"""

VALID = "xmin >= 0 AND ymin >= 0 AND xmax > xmin AND ymax > ymin AND xmax <= width AND ymax <= height"

#: Converted labels with planted faults: shifted boxes, lost rows, bad classes, sizes and coordinates.
LABELS = f"""SELECT image_id, object_index AS line_no, CASE WHEN pk % 317 = 0 THEN 4 ELSE 5 END AS n_values, CAST(CASE WHEN pk % 307 = 0 THEN 1 ELSE 0 END AS BIGINT) AS class_id,
  CASE WHEN pk % 313 = 0 THEN CAST(1.1 AS DOUBLE) ELSE ((xmin + xmax) / 2 + CASE disc WHEN 10 THEN 2 WHEN 9 THEN 1 ELSE 0 END) / width END AS xc,
  (ymin + ymax) / 2 / height AS yc, CASE WHEN pk % 311 = 0 THEN CAST(0.0 AS DOUBLE) ELSE (xmax - xmin) / width END AS w, (ymax - ymin) / height AS h, width, height
  FROM ({BOXES}) b WHERE {VALID} AND NOT (tax = 8 AND flag = 'R')"""

#: Source boxes of the review: the valid ones.
SOURCE = f"SELECT image_id, object_index, class_name, xmin, ymin, xmax, ymax, width, height FROM ({BOXES}) b WHERE {VALID}"

MANIFEST = f"""SELECT i.image_id, CASE WHEN k % 1009 = 0 THEN 'train' WHEN k % 2003 = 0 THEN 'hold' ELSE CASE WHEN h < '44' THEN 'test' WHEN h < '88' THEN 'val' ELSE 'train' END END AS split,
  path AS image_path, concat('labels/', i.image_id, '.txt') AS label_path, CASE WHEN k % 887 = 0 THEN concat('/data/', i.image_id) ELSE path END AS source_image_path, concat('xml/', i.image_id, '.xml') AS source_xml_path,
  CAST(coalesce(n, 0) AS BIGINT) AS object_count, CAST(coalesce(s, 0) AS BIGINT) AS small_box_count, CASE WHEN k % 3 = 0 THEN sha256 ELSE '' END AS duplicate_group_id, k
  FROM (SELECT *, substr(md5(CASE WHEN k % 3 = 0 THEN sha256 ELSE image_id END), 1, 2) AS h FROM ({IMAGES}) x) i
  LEFT JOIN (SELECT image_id AS id, count(*) AS n, sum(CASE WHEN xmax - xmin <= 10 OR ymax - ymin <= 10 THEN 1 ELSE 0 END) AS s FROM ({SOURCE}) q GROUP BY image_id) c ON i.image_id = c.id"""

PREDICTIONS = f"""SELECT image_id, 0 AS class_id, object_index AS pred_id, CAST(pk * 7919 % 1000 AS DOUBLE) / 1000.0D AS confidence, xmin + sk % 5 AS xmin, ymin, xmax + sk % 5 AS xmax, ymax
  FROM ({BOXES}) b WHERE {VALID} AND pk % 4 <> 0"""
TRUTH = f"SELECT image_id, 0 AS class_id, object_index AS truth_id, xmin, ymin, xmax, ymax FROM ({BOXES}) b WHERE {VALID}"

EPOCHS = """SELECT run, epoch, CASE WHEN epoch % 97 = 0 THEN NULL WHEN epoch % 89 = 0 THEN CAST(0.0 AS DOUBLE) ELSE value END AS map50, value * 2 AS loss FROM
  (SELECT event_type AS run, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INT) AS epoch, value FROM {events}) e"""

TABLES = ("orders", "lineitem", "events", "documents", "pages", "conversations", "part", "supplier", "customer")


def duck(text: str) -> str:
    return text.format(**{t: t for t in TABLES}, sha="sha256(", end=")").replace("1000.0D", "1000.0::DOUBLE").replace("0.75D", "0.75::DOUBLE")


def spark_sql(text: str, sf_dir: str) -> str:
    return text.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}, sha="sha2(", end=", 256)")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(spark_sql(text, sf_dir))
