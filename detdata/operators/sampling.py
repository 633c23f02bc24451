"""Risk-focused, repeatable samples for human review. Seeded order is md5(seed:id), so samples agree everywhere; they
keep the quotas and strata of a seeded random draw, not the rows of a particular generator."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.scalars import seeded_order
from ..storage import written

#: Rows of each risk rule: (reason, column, rows, only positive values).
RISK_RULES = (("highest_object_count", "object_count", 10, False), ("contains_very_small_box", "small_box_count", 10, True), ("unusual_large_box", "largest_area", 5, False), ("unusual_aspect_ratio", "largest_aspect", 5, False))

#: Lists ask for ids in rounds while each settles this part of those that asked.
LEAST_PROGRESS = 0.1


def top_by_risk(images: DataFrame, rules: tuple = RISK_RULES) -> DataFrame:
    """(rule_no, image_id, reason, rank): the top rows of each rule, ties by image_id, images without boxes (null, or NaN)
    last. The small-box rule is cut before its zero rows go.

    All rules are served by one scan: a task holds the best rows of each, as many as the rule asks for, and puts each batch
    to them; what the tasks hold at their ends is ranked together.
    """
    columns = list(dict.fromkeys(c for _, c, _, _ in rules))
    src = images.select("image_id", *columns)
    kind = to_arrow_type(src.schema["image_id"].dataType)

    def run(batches):
        best: list[pa.Table | None] = [None] * len(rules)
        for b in batches:
            for no, (_, column, k, _) in enumerate(rules):
                rows = pa.table({"image_id": b.column("image_id"), "v": pc.cast(b.column(column), pa.float64())})
                rows = rows if best[no] is None else pa.concat_tables([best[no], rows])
                order = pc.sort_indices(rows, sort_keys=[("v", "descending"), ("image_id", "ascending")], null_placement="at_end")
                best[no] = rows.take(order[:k])
        for no, rows in enumerate(best):
            if rows is not None:
                yield from rows.cast(pa.schema([("image_id", kind), ("v", pa.float64())])).append_column("rule_no", pa.array([no] * len(rows), pa.int32())).to_batches()

    id_kind = src.schema["image_id"].dataType.simpleString()
    held = src.mapInArrow(run, f"image_id {id_kind}, v double, rule_no int")
    order = Window.partitionBy("rule_no").orderBy(F.when(~F.isnan("v"), F.col("v")).desc_nulls_last(), F.col("image_id").asc_nulls_last())
    most = F.element_at(F.array(*[F.lit(k) for _, _, k, _ in rules]), F.col("rule_no") + 1)
    reason = F.element_at(F.array(*[F.lit(r) for r, _, _, _ in rules]), F.col("rule_no") + 1)
    positive = F.element_at(F.array(*[F.lit(x) for _, _, _, x in rules]), F.col("rule_no") + 1)
    top = held.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= most) & (~positive | F.coalesce(F.col("v") > 0, F.lit(False))))
    return top.select("rule_no", "image_id", reason.alias("reason"), "rank")


def duplicate_members(members: DataFrame, limit: int | None = None) -> DataFrame:
    """members(image_id, group) of a group with a reason that names it by 12 digits; the first `limit` by (group, id) if
    one is given."""
    rows = members.where("coalesce(`group`, '') != ''").select("image_id", "group", F.concat(F.lit("duplicate_group:"), F.substring("group", 1, 12)).alias("reason"))
    return rows if limit is None else rows.orderBy("group", "image_id").limit(limit)


def split_list_representatives(lists: DataFrame) -> DataFrame:
    """(list_name, image_id): per list, in name order, its first id that no earlier list took, else its first id.

    All lists ask at once for their first id; an id goes to the earliest list that asks for it, also if a later one held it
    until then, and the others ask for their next one, until none is left to ask. As all lists want small ids first and all
    ids earlier lists, that ends with what the lists would have taken one after another. Lists that share few ids end in a
    few rounds. Once a round settles less than a tenth of those that asked, many lists want the same ids: then one task
    reads the ids in order and gives each to the earliest list without one, holding the names of the lists that have one.
    """
    ids = written(lists.select("list_name", "image_id").distinct(), "list_ids")
    firsts = ids.groupBy("list_name").agg(F.min("image_id").alias("first"))
    known = ids.where("image_id is not null")
    asking = written(firsts.where("first is not null").select("list_name", F.lit(None).cast(ids.schema["image_id"].dataType).alias("after")), "asking")
    held, n = known.limit(0), asking.count()
    while n:
        asked = known.join(asking, "list_name").where(F.col("after").isNull() | (F.col("image_id") > F.col("after"))).groupBy("list_name").agg(F.min("image_id").alias("image_id"))
        both = held.unionByName(asked)
        earliest = both.groupBy("image_id").agg(F.min("list_name").alias("earliest"))
        judged = written(both.join(earliest, "image_id"), "judged")
        held = judged.where("list_name = earliest").select("list_name", "image_id")
        asking, before = judged.where("list_name != earliest").select("list_name", F.col("image_id").alias("after")), n
        n = asking.count()
        if n > (1 - LEAST_PROGRESS) * before:
            held = written(_in_order(known), "held")
            break
    return firsts.join(held, "list_name", "left").select("list_name", F.coalesce("image_id", "first").alias("image_id"))


def _in_order(ids: DataFrame) -> DataFrame:
    """(list_name, image_id): ids in order, each given to the earliest list that holds it and has none yet."""
    rows = ids.select("image_id", "list_name").repartition(1).sortWithinPartitions("image_id", "list_name")

    def run(batches):
        served, last = set(), None
        for b in batches:
            keep = []
            for at, (i, name) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if i != last and name not in served:
                    served.add(name)
                    last = i
                    keep.append(at)
            yield b.take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(run, rows.schema).select("list_name", "image_id")


def seeded_sample_per_split(rows: DataFrame, quota: dict[str, int], seed: int, strict: bool = False) -> DataFrame:
    """rows of each split up to its quota, in seeded order. strict: a split with fewer is an error."""
    spark = rows.sparkSession
    limits = spark.createDataFrame([(k, v) for k, v in quota.items()], "split string, _quota int")
    w = Window.partitionBy("split").orderBy(seeded_order(seed, F.col("image_id")), "image_id")
    most = max(quota.values())
    out = rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).join(F.broadcast(limits), "split").where(F.col("_rank") <= F.col("_quota"))  # a row per split
    if strict:
        got = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
        short = [s for s, q in quota.items() if got.get(s, 0) < q]
        if short:
            raise ValueError(f"too few rows in {', '.join(short)}")
    return out.drop("_rank", "_quota")


def fill_sample(rows: DataFrame, selected: DataFrame, size: int, seed: int) -> DataFrame:
    """The next rows in seeded order that are not selected, as many as the sample still lacks."""
    lacks = size - selected.select("image_id").distinct().count()
    rest = rows.join(selected.select("image_id").distinct(), "image_id", "left_anti")
    return rest.orderBy(seeded_order(seed, F.col("image_id")), "image_id").limit(max(lacks, 0))


def combine_sample_reasons(picks: DataFrame, size: int, strict: bool = False) -> DataFrame:
    """picks(rule_no, rank, image_id, reason) → (image_id, reasons): reasons in rule order without repeats, images by their
    first rule and rank, at most `size`. strict: more images than that is an error."""
    if size <= 0:
        raise ValueError("a sample has a positive size")
    firsts = picks.groupBy("image_id", "reason").agg(F.min(F.struct("rule_no", "rank")).alias("f"))
    per = firsts.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "reason"))), lambda x: x["reason"]).alias("reasons"), F.min("f").alias("f"))
    if strict and per.count() > size:
        raise ValueError("the sample is too small for its rules")
    return per.orderBy("f", "image_id").limit(size).select("image_id", "reasons")
