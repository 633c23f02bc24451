"""Assignment of images to splits with duplicate groups kept whole."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import seeded_order
from ..schemas import SPLITS
from ..storage import written

#: Groups of a profile that are dealt out together, and whose choices travel in one row.
CHUNK = 65_536
#: Weights of images, objects and small boxes in a split's utilisation.
WEIGHTS = (4.0, 1.0, 1.0)


def validate_ratios(ratios: dict[str, float]) -> None:
    if set(ratios) != set(SPLITS) or any(r <= 0 for r in ratios.values()) or abs(sum(ratios.values()) - 1) > 1e-9:
        raise ValueError("ratios are positive, for train, val and test, and sum to 1")


def with_group_key(items: DataFrame) -> DataFrame:
    """items(image_id, object_count, small_box_count, duplicate_group_id) with key: the group, or the image alone."""
    alone = F.coalesce("duplicate_group_id", F.lit("")) == ""
    return items.withColumn("key", F.when(alone, F.concat(F.lit("single:"), "image_id")).otherwise(F.col("duplicate_group_id")))


def form_split_groups(items: DataFrame) -> DataFrame:
    """(key, images, objects, small): what each group brings to a split."""
    return with_group_key(items).groupBy("key").agg(F.count("*").alias("images"), F.sum("object_count").alias("objects"), F.sum("small_box_count").alias("small"))


def require_items(items: DataFrame) -> None:
    if items.isEmpty():
        raise ValueError("there are no images to split")
    if items.groupBy("image_id").count().where("count > 1").limit(1).count():
        raise ValueError("an image id occurs twice")


class _Filling:
    """How far each split is used while a run of equal groups (a profile) is dealt out.

    The rule puts each group where `used` is least, ties by name. `used` of a split depends only on how many of the
    run it holds, so the picks are the merge of one rising sequence per split, and the state after any number of
    picks is found by bisection, without walking there."""

    def __init__(self, target: dict, held: dict, step: tuple[int, int, int]):
        self.target, self.held, self.step = target, held, step

    def used(self, s: str, n):
        """Utilisation of split s with n groups of the run, n a number or an array of numbers."""
        return sum(w * (h + n * d) / t for w, h, d, t in zip(WEIGHTS, self.held[s], self.step, self.target[s], strict=True))

    def _before(self, t: str, s: str, value: float, most: int) -> int:
        """Picks of t that come before a pick of s at this value, `most` at most."""
        lo, hi = 0, most
        while lo < hi:
            mid = (lo + hi) // 2
            if (self.used(t, mid), t) < (value, s):
                lo = mid + 1
            else:
                hi = mid
        return lo

    def after(self, n: int) -> dict[str, int]:
        """Groups of each split after n picks."""
        out = {}
        for s in SPLITS:
            lo, hi = 0, n
            while lo < hi:  # the first pick of s that is not among the first n
                mid = (lo + hi) // 2
                value = self.used(s, mid)
                if mid + sum(self._before(t, s, value, n) for t in SPLITS if t != s) < n:
                    lo = mid + 1
                else:
                    hi = mid
            out[s] = lo
        return out


def _at_least_one(targets: dict[str, tuple[float, float, float]]) -> dict:
    return {s: tuple(max(t, 1.0) for t in targets[s]) for s in SPLITS}


#: Of a chunk of a profile: its number, its groups, and what each split holds before it (images, objects, small boxes).
_CHUNKS = "objects long, images long, small long, chunk long, size long, held array<long>"


def _chunk_states(targets: dict[str, tuple[float, float, float]], size: int):
    """Walks the profiles in order and tells the state before each chunk of `size` of their groups."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, held = _at_least_one(targets), {s: (0, 0, 0) for s in SPLITS}
        for pdf in batches:
            for objects, images, small, n in pdf[["objects", "images", "small", "n"]].itertuples(index=False):
                step, rows = (int(images), int(objects), int(small)), []
                filling = _Filling(target, held, step)
                moved = lambda k: {s: tuple(h + c * d for h, d in zip(held[s], step, strict=True)) for s, c in filling.after(k).items()}  # noqa: B023, E731
                for chunk in range(-(-n // size)):
                    now = moved(chunk * size) if chunk else held
                    rows.append((objects, images, small, chunk, min(size, n - chunk * size), [x for s in SPLITS for x in now[s]]))
                held = moved(int(n))
                yield pd.DataFrame(rows, columns=["objects", "images", "small", "chunk", "size", "held"])

    return run


def _chunk_choices(targets: dict[str, tuple[float, float, float]]):
    """The choices of each chunk, from its own state: what each split is used before each of the picks that it gets, all
    sorted together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target = _at_least_one(targets)
        for pdf in batches:
            for objects, images, small, chunk, size, flat in pdf.itertuples(index=False):
                held = {s: tuple(int(x) for x in flat[3 * i : 3 * i + 3]) for i, s in enumerate(SPLITS)}
                filling = _Filling(target, held, (int(images), int(objects), int(small)))
                picks = {s: np.arange(n, dtype=np.float64) for s, n in filling.after(int(size)).items()}
                used = np.concatenate([filling.used(s, picks[s]) for s in SPLITS])
                which = np.repeat(np.arange(len(SPLITS), dtype=np.int32), [len(picks[s]) for s in SPLITS])
                order = np.lexsort((np.concatenate([picks[s] for s in SPLITS]), which, used))
                yield pd.DataFrame({"objects": [objects], "images": [images], "small": [small], "chunk": [chunk], "choices": [which[order]]})

    return run


def assign_splits(items: DataFrame, ratios: dict[str, float], chunk: int = CHUNK) -> DataFrame:
    """(image_id, split) by the exact greedy rule: groups by descending objects, images and small boxes, then key; each
    goes to the split whose targets are used least. A seed has no effect, since the order is total.

    A group's effect depends only on its profile (objects, images, small). One task walks the table of profiles with
    their counts and finds, by bisection, what each split holds before every `chunk` groups; the chunks are dealt out in
    parallel from there. The groups are ranked inside their profile in parallel, by range partitions and offsets, and
    pick up their choice by an equi-join on (profile, chunk). No images, or an image id twice, is an error.
    """
    validate_ratios(ratios)
    require_items(items)
    groups = form_split_groups(items)
    profile = ["objects", "images", "small"]
    t = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("images", "objects", "small")]).first()
    targets = {s: tuple(float(t[c]) * r for c in ("images", "objects", "small")) for s, r in ratios.items()}
    order = [F.col(c).desc() for c in profile]
    counts = groups.groupBy(*profile).agg(F.count("*").alias("n")).repartition(1).sortWithinPartitions(*order)
    chunks = written(counts.mapInPandas(_chunk_states(targets, chunk), _CHUNKS), "split_chunks")
    chosen = chunks.repartition(*profile, "chunk").mapInPandas(_chunk_choices(targets), "objects long, images long, small long, chunk long, choices array<int>")

    parts = written(groups.repartitionByRange(*profile, "key").withColumn("_part", F.spark_partition_id()), "split_groups")
    offsets = parts.groupBy("_part", *profile).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*profile).orderBy("_part")) - F.col("_n")
    inside = F.row_number().over(Window.partitionBy("_part", *profile).orderBy("key")) - 1
    ranked = parts.withColumn("_inside", inside).join(offsets.withColumn("_before", before).drop("_n"), ["_part", *profile])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_inside")).withColumn("chunk", F.floor(F.col("_rank") / chunk))
    names = F.array(*[F.lit(s) for s in SPLITS])
    split = F.get(names, F.get("choices", (F.col("_rank") % chunk).cast("int")))
    assigned = ranked.join(chosen, [*profile, "chunk"]).select("key", split.alias("split"))
    return with_group_key(items).join(assigned, "key").select("image_id", "split")


def assign_splits_hash(items: DataFrame, ratios: dict[str, float], seed: int = 42) -> DataFrame:
    """(image_id, split) by the hash of the group key: stateless, so an image keeps its split as the data grows."""
    validate_ratios(ratios)
    u = F.conv(F.substring(seeded_order(seed, F.col("key")), 1, 8), 16, 10).cast("double") / 2.0**32
    order = sorted(ratios)
    split, edge = F.lit(order[-1]), 1.0
    for s in reversed(order[:-1]):
        edge = sum(ratios[x] for x in order[: order.index(s) + 1])
        split = F.when(u < edge, s).otherwise(split)
    return with_group_key(items).select("image_id", split.alias("split"))


def assign_splits_stratified(items: DataFrame, ratios: dict[str, float], seed: int = 42) -> DataFrame:
    """(image_id, split) with the ratios met inside each profile of groups, by rank of the seeded hash."""
    validate_ratios(ratios)
    w = Window.partitionBy("objects", "images", "small").orderBy(seeded_order(seed, F.col("key")), "key")
    rank = (F.row_number().over(w) - 0.5) / F.count("*").over(Window.partitionBy("objects", "images", "small"))
    order = sorted(ratios)
    split = F.lit(order[-1])
    for s in reversed(order[:-1]):
        split = F.when(rank < sum(ratios[x] for x in order[: order.index(s) + 1]), s).otherwise(split)
    picked = form_split_groups(items).select("key", split.alias("split"))
    return with_group_key(items).join(picked, "key").select("image_id", "split")


def split_violations(items: DataFrame, assigned: DataFrame) -> DataFrame:
    """(kind, key): images without a split, and groups in several."""
    lost = items.join(assigned, "image_id", "left_anti").select(F.lit("unassigned").alias("kind"), F.col("image_id").alias("key"))
    rows = with_group_key(items).join(assigned, "image_id")
    torn = rows.groupBy("key").agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.lit("group crosses splits").alias("kind"), "key")
    return lost.unionByName(torn)


def check_split_invariants(items: DataFrame, assigned: DataFrame) -> None:
    n = split_violations(items, assigned).count()
    if n:
        raise ValueError(f"{n} split violations")
