"""What the operators of this package share: words, shared folders, written tables."""

import ctypes
import functools
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE_RE, WORD_RE = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased. translate goes character by character, so it is left to texts beyond ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Runs of characters that are no white space; a null text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RE + "+"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a local session (tests) gets one of its own."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_to = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(set_to)
        set_to = spark.sparkContext.getCheckpointDir()
    return set_to.rstrip("/")


#: Folders of the operators that are at work in this thread, the innermost last.
_SCRATCH: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside go to a folder of their own, which is deleted at the end."""
    own = new_path(spark, "scratch")
    before = _SCRATCH.set((*_SCRATCH.get(), own))
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        discard(spark, own)


def written(df: DataFrame, name: str, up: int = 0, by: str | None = None) -> DataFrame:
    """df, written as a table (in folders by a column, if one is given) in the shared folder and read back: its
    lineage ends there, so a lost executor costs no recomputation, and the shuffle files it took are freed at once.
    Inside scratch() the table lives as long as the block that is `up` blocks further out."""
    spark, open_ = df.sparkSession, _SCRATCH.get()
    folder = open_[-1 - up] if len(open_) > up else shared_dir(spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bits of a key filter per key, and its least and greatest number of rows, each of them a bitmap of 2^15 bits: 2 MB for
#: up to a million keys; 128 MB, which bounds what is sent to the executors, from 67 million on.
FILTER_BITS, FILTER_ROWS, MOST_FILTER_ROWS = 16, 512, 32_768


def _key(columns: list[Column]) -> Column:
    return F.xxhash64(*[c.isNull() for c in columns], *columns)


def _may_hold(df: DataFrame, columns: list[Column], table: DataFrame, names: list[str]) -> DataFrame:
    """df with _may: false only where no row of table, a written one, has these keys. Built-in functions only. The filter
    grows with the number of keys and lets 1 in 16 of the other rows pass at most, up to its greatest size; of still more
    keys it tells fewer rows apart."""
    size, n = FILTER_ROWS, table.count()
    while size < MOST_FILTER_ROWS and size * (1 << 15) < n * FILTER_BITS:
        size *= 2
    place = lambda h: (F.pmod(F.shiftright(h, 20), F.lit(size)).cast("int"), F.pmod(h, F.lit(1 << 15)))
    row, bit = place(_key([F.col(n) for n in names]))
    bits = table.select(row.alias("_row"), bit.alias("_bit")).groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    bits = written(bits, "key_filter")
    row, bit = place(_key(columns))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    one = F.call_function("shiftright", byte, (F.col("_bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    keys = [c.alias(f"_key{i}") for i, c in enumerate(columns)]
    placed = df.select(F.struct(*[df[c] for c in df.columns]).alias("_whole"), row.alias("_row"), bit.alias("_bit"), *keys)
    # the filter's size is bounded: MOST_FILTER_ROWS rows of 4 KB
    return placed.join(F.broadcast(bits), "_row", "left").select("_whole", *[f"_key{i}" for i in range(len(keys))], F.coalesce(one, F.lit(False)).alias("_may"))


def _same(rows: DataFrame, table: DataFrame, names: list[str]) -> Column:
    at = F.lit(True)
    for i, name in enumerate(names):
        at = at & rows[f"_key{i}"].eqNullSafe(table[name])
    return at


def within(df: DataFrame, columns: dict[str, Column], table: DataFrame) -> DataFrame:
    """df joined with the rows of table (its columns behind df's) that have equal keys, null equal to null. columns are
    the keys, expressions over df, by their names in table. Of df only rows that a key filter lets pass are shuffled; they
    are joined so at every size, since they are few while the table is small."""
    rows = _may_hold(df, list(columns.values()), table, list(columns)).where("_may")
    return rows.join(table.hint("merge"), _same(rows, table, list(columns))).select("_whole.*", *[table[c] for c in table.columns])


def without(df: DataFrame, columns: dict[str, Column], table: DataFrame) -> DataFrame:
    """Rows of df whose keys no row of table has, as in within."""
    rows = _may_hold(df, list(columns.values()), table, list(columns))
    may = rows.where("_may")
    rest = may.join(table.hint("merge"), _same(may, table, list(columns)), "left_anti")
    return rows.where("not _may").select("_whole.*").unionByName(rest.select("_whole.*"))


def lean(run):
    """A map over Arrow batches that hands freed memory back to the system when its task ends. Spark keeps idle Python
    workers, which otherwise hold the most that any of their tasks took, beside the tasks of later stages."""

    @functools.wraps(run)
    def mapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return mapped
