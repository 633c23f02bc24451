"""A corpus pipeline of five stages over documents: quality rules, near-duplicate removal by an n-gram Jaccard
join, benchmark decontamination, mixing of sources to target weights, and token shards.

Each stage is a function (spark, docs, sf_dir) -> DataFrame on all that its predecessor kept. All but the last
return the columns of documents. A stage decides about rows by their doc_id and text, so rows that share an id, or
have none, are judged each by its own text; rows that repeat both are copies of one document.

Texts are not shuffled per decision: a filter joins the table of the rows that go to those texts only that a key filter
of bounded size lets pass.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detdata.llm import repair_codec
from detdata.llm.common import read, within, without, written
from detdata.llm.decontam import contaminated
from detdata.llm.quality_rules import kept_documents
from detdata.llm.queries import tokenizer_path
from detdata.llm.shingle_join import similar_components
from detdata.llm.source_mix import mix_sources as draw_copies


def _row_keys(docs: DataFrame) -> dict:
    """What tells rows apart: id and text."""
    return {"_wanted": docs["doc_id"], "_hash": F.xxhash64(docs["text"])}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return kept_documents(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, Jaccard 0.8) the first by doc_id, null last, and text hash; of rows
    that repeat both one. Rows without words stay."""
    found = similar_components(docs, k=5, num=4, den=5).select(F.col("doc_id").alias("_wanted"), F.col("text_hash").alias("_hash"), "n_shingles", "is_first")
    left = without(docs, _row_keys(docs), written(found.where("not is_first").select("_wanted", "_hash").distinct(), "near_copies"))
    again = written(found.where("is_first and n_shingles > 0").groupBy("_wanted", "_hash").count().where("count > 1").drop("count"), "repeated")
    # only rows that repeat id and text are dealt out whole
    row = F.struct(*[docs[c] for c in docs.columns])
    equal = within(docs.select(row.alias("_row")), {"_wanted": F.col("_row.doc_id"), "_hash": F.xxhash64("_row.text")}, again)
    one = equal.groupBy("_wanted", "_hash").agg(F.min("_row").alias("_row")).select("_row.*")
    return without(left, _row_keys(left), again).unionByName(one)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    named = docs.select(F.struct(F.col("doc_id").alias("_wanted"), F.xxhash64("text").alias("_hash")).alias("row"), "text")
    found = contaminated(named, read(spark, sf_dir, "benchmark"), doc_id="row").select("row._wanted", "row._hash")
    return without(docs, _row_keys(docs), written(found.distinct(), "contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows are told apart by all their columns."""
    columns = [docs[c] for c in docs.columns]
    whole = F.xxhash64(*[c.isNull() for c in columns], *columns)
    named = docs.select(F.struct(F.col("doc_id").alias("_wanted"), whole.alias("_hash")).alias("row"), "text", "source")
    drawn = draw_copies(named, doc_id="row").groupBy("row").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0")
    drawn = written(drawn.select("row._wanted", "row._hash", "_copies", "_rows"), "copies")
    rows = docs.select(F.struct(*columns).alias("_row"), F.col("doc_id").alias("_id"), whole.alias("_all"))
    found = rows.join(drawn, rows["_id"].eqNullSafe(drawn["_wanted"]) & (rows["_all"] == drawn["_hash"])).select("_row", "_id", "_all", "_copies", "_rows")
    # rows that are equal in all columns give their copies together, from one of them
    out = found.where("_rows = 1").unionByName(found.where("_rows > 1").dropDuplicates(["_id", "_all"]))
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("_row.*")


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Re-Pair shards of all token ids, and what decoding them gives: doc_id, start, n_tokens, ids_crc32."""
    return repair_codec.encode(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", mix_sources),
    ("token shards", token_shards),
]

#: SQL can't express the tokenizer or the rounding; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
