"""Joins of source and converted boxes of one image, and their greedy one-to-one matching.

Images of usual size take the direct way: an equi-join on the image, and a fold over an image's pairs in order. Images
whose boxes would make more than DENSE candidate pairs are told by two counts and go another way, in which no task
depends on one image: a grid of levels finds the pairs, and rounds of dominant pairs match them, band by band of IoU.
"""

import math
from collections.abc import Callable
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.geometry import box, coordinate_delta, iou
from ..storage import freed, written

#: Side of a cell in pixels on the grid's lowest level.
CELL = 64.0
#: Boxes that a cell of an even grid should hold, and cells that a box may lie in there on average.
CELL_BOXES, CELLS_EACH = 1024, 2.0
#: Candidate pairs (boxes of one side times boxes of the other) from which on an image is dense.
DENSE = 1 << 16
#: Beyond this, and nearer to 0 than NEAR, a coordinate is not put on a grid.
FAR, NEAR = float(1 << 50), 2.0**-100
#: Candidate pairs of an image up to which pair_boxes_dense takes it as one cell.
ONE_CELL = 64
#: Pairs up to which rounds aren't worth their jobs: these are matched in order, an image a task.
FEW = 1 << 20
#: Rounds go on while each takes this part of the pairs away; what then is left is matched in order, an image a task.
LEAST_PROGRESS = 0.1
#: Least IoU of the pairs that are made and matched first, next and so on; at last all.
BANDS = (0.25, 1 / 256, 0.0)

_CORNERS = ("xmin", "ymin", "xmax", "ymax")


def _side(boxes: DataFrame, prefix: str) -> DataFrame:
    """Boxes with prefixed columns."""
    return boxes.select("image_id", F.col("object_index").alias(prefix + "index"), *[F.col(c).alias(prefix + c) for c in _CORNERS])


def _measured(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("iou", iou(box("s_"), box("d_"))).withColumn("delta", coordinate_delta(box("s_"), box("d_"))).where("iou > 0 and not isnan(iou)")


def _measured_overlaps(pairs: DataFrame) -> DataFrame:
    """_measured for boxes of the grid, all of which overlap. With so many pairs, a short expression is worth while: the
    JVM doesn't compile a loop whose code is as long as that of the general one."""
    less, more = (lambda a, b: F.when(a < b, a).otherwise(b)), (lambda a, b: F.when(a < b, b).otherwise(a))
    s, d = box("s_"), box("d_")
    both = (less(s[2], d[2]) - more(s[0], d[0])) * (less(s[3], d[3]) - more(s[1], d[1]))
    union = (s[2] - s[0]) * (s[3] - s[1]) + (d[2] - d[0]) * (d[3] - d[1]) - F.col("_both")
    return pairs.withColumn("_both", both).withColumn("iou", F.col("_both") / union).withColumn("delta", coordinate_delta(s, d)).drop("_both")


def _overlap() -> Column:
    return (F.col("s_xmin") < F.col("d_xmax")) & (F.col("d_xmin") < F.col("s_xmax")) & (F.col("s_ymin") < F.col("d_ymax")) & (F.col("d_ymin") < F.col("s_ymax"))


def dense_images(source: DataFrame, converted: DataFrame, dense: int = DENSE) -> tuple[DataFrame, bool]:
    """(image_id) of images with more than `dense` candidate pairs, written; and whether there are other images with any.
    Only ids are read and counted."""
    counts = lambda boxes, n: boxes.groupBy("image_id").agg(F.count("*").alias(n))
    is_dense = F.col("_s").cast("double") * F.col("_d") > dense
    seen = Observation()
    both = counts(source, "_s").join(counts(converted, "_d"), "image_id").observe(seen, F.count_if(~is_dense).alias("others"))
    found = written(both.where(is_dense).select("image_id"), "dense_images")
    freed(found.sparkSession)
    return found, seen.get["others"] > 0


def pair_boxes_directly(source: DataFrame, converted: DataFrame) -> DataFrame:
    """pair_boxes by a join on the image with overlap as a further condition."""
    return _measured(_side(source, "s_").join(_side(converted, "d_"), "image_id").where(_overlap()))


def pair_boxes_dense(source: DataFrame, converted: DataFrame, cell: float = CELL) -> DataFrame:
    """pair_boxes for images with very many boxes of any sizes, on a grid. An image with ONE_CELL candidate pairs at most is
    one cell of its own: dealt out over small cells, its boxes would lie in several and gain nothing.

    Each side is worked out and written by itself first, so that the shuffles of one at a time lie on the disk."""
    sides = []
    for boxes, name in ((source, "source"), (converted, "converted")):
        sides.append(written(boxes.select("image_id", "object_index", *_CORNERS), name))
        freed(boxes.sparkSession)
    return pair_boxes(*sides, ONE_CELL, cell)


def pair_on_grid(source: DataFrame, converted: DataFrame, cell: float = CELL, least: float = 0.0, flat: bool = True) -> DataFrame:
    """pair_boxes by a grid; of pairs with an IoU of `least` at least.

    An image gets cells of one size that hold some CELL_BOXES boxes each, if exact counts say that its boxes then lie in
    CELLS_EACH cells each on average at most and meet few others there; so a box is dealt out about once. Where sizes or
    places are too uneven for that (always if not `flat`), it gets a grid of levels.

    Level 0 of the grid has cells of side `cell`, each level twice the side of the one before. A box belongs to the lowest
    level whose cells are as large as it, so it lies in four cells there at most, and in one to four on a higher level: a
    page-wide box never goes to the small cells that it covers. Two boxes meet on the higher of their two levels, the lower
    one looking up. Only levels that the other side has in that image are looked up to. The larger boxes, which are few,
    are the side that a join holds; those that look up stream past them. An IoU is at most the quotient of two widths or
    heights, so with `least` a box looks up a few levels only.

    Two boxes count in the cell of the upper left corner of what they share, so once: that is where each of the cell's two
    coordinates is the first one of either box.

    Boxes without a finite positive area, or with a coordinate beyond 2**50 pixels or, other than 0, below 2**-100, are
    paired directly. Of the others, those that overlap have an IoU above 0 and no step that leaves the range of a double.
    """
    size = lambda c: F.abs(F.col(c))
    placed = lambda c: (size(c) < FAR) & ((size(c) == 0) | (size(c) >= NEAR))
    ok = lambda p: F.coalesce((F.col(p + "xmax") > F.col(p + "xmin")) & (F.col(p + "ymax") > F.col(p + "ymin")) & reduce(and_, [placed(p + c) for c in _CORNERS]), F.lit(False))
    s, d = _side(source, "s_"), _side(converted, "d_")
    s_own, d_own = s.where(ok("s_")), d.where(ok("d_"))
    known = _grids(s_own, d_own, cell, flat)
    reach = math.ceil(-math.log2(least)) + 1 if least > 0 else 1 << 20

    def cells(boxes: DataFrame, p: str, of: str | None, least_up: int = 0) -> DataFrame:
        """Cells at home, or on the levels of the other side from `least_up` above home on."""
        rows = boxes.join(known, "image_id")
        own = F.when(F.col("is_flat"), 0).otherwise(_level(p, cell))
        rows = rows.withColumn("level", own if of is None else F.explode(F.filter(of + "levels", lambda v: (v >= own + least_up) & (v <= own + reach))))
        ends = _ends(p, F.col("side") * F.pow(F.lit(2.0), F.col("level")))
        rows = rows.drop("s_levels", "d_levels", "is_flat").withColumns(ends).drop("side").withColumn("cx", F.explode(F.sequence("_x0", "_x1"))).withColumn("cy", F.explode(F.sequence("_y0", "_y1")))
        first = F.when(F.col("cx") == F.col("_x0"), 1).otherwise(0) + F.when(F.col("cy") == F.col("_y0"), 2).otherwise(0)
        return rows.withColumn(p + "first", first).drop(*ends)

    key = ["image_id", "level", "cx", "cy"]
    names = ["image_id", *s.columns[1:], *d.columns[1:]]
    once = F.col("s_first").bitwiseOR(F.col("d_first")) == 3
    met = lambda up, home: up.join(home, key).where(_overlap() & once).select(*names)
    out = met(cells(d_own, "d_", "s_"), cells(s_own, "s_", None))
    if not known.where("not is_flat").isEmpty():
        out = out.unionByName(met(cells(s_own, "s_", "d_", 1), cells(d_own, "d_", None)))
    out = _measured_overlaps(out)
    odd = lambda boxes, p: boxes.where(~ok(p))
    if not (odd(s, "s_").isEmpty() and odd(d, "d_").isEmpty()):
        far = odd(s, "s_").join(d, "image_id").unionByName(s_own.join(odd(d, "d_"), "image_id"))
        out = out.unionByName(_measured(far.where(_overlap()).select(*names)))
    return out.where(F.col("iou") >= least) if least > 0 else out


def _level(p: str, cell: float) -> Column:
    """The lowest level whose cells are as large as the box."""
    longest = F.greatest(F.col(p + "xmax") - F.col(p + "xmin"), F.col(p + "ymax") - F.col(p + "ymin"))
    return F.greatest(F.lit(0), F.ceil(F.log2(longest / cell))).cast("int")


def _ends(p: str, side: Column) -> dict[str, Column]:
    """First and last cell of a box in both directions."""
    return {n: F.floor(F.col(p + c) / side) for n, c in (("_x0", "xmin"), ("_x1", "xmax"), ("_y0", "ymin"), ("_y1", "ymax"))}


def _grids(s: DataFrame, d: DataFrame, cell: float, flat: bool) -> DataFrame:
    """(image_id, s_levels, d_levels, is_flat, side) of images that both sides have: the levels that hold boxes and the side
    of a cell of level 0. Written."""
    facts = lambda boxes, p: boxes.groupBy("image_id").agg(F.collect_set(_level(p, cell)).alias(p + "levels"), F.count("*").alias(p + "n"), (F.stddev_pop(p + "xmin") * F.stddev_pop(p + "ymin")).alias(p + "spread"))
    # boxes dealt out evenly over an area have 12 times that spread
    area = 12 * F.greatest("s_spread", "d_spread")
    side = F.greatest(F.lit(cell), F.sqrt(area * CELL_BOXES / (F.col("s_n") + F.col("d_n"))))
    known = written(facts(s, "s_").join(facts(d, "d_"), "image_id").withColumn("_side", side), "levels")
    leveled = known.select("image_id", "s_levels", "d_levels", F.lit(False).alias("is_flat"), F.lit(cell).alias("side"))
    if not flat:
        return leveled
    sides = known.where(F.col("_side") < FAR).select("image_id", "_side", (F.col("s_n") + F.col("d_n")).alias("_n"))
    many = lambda boxes, p: boxes.join(sides, "image_id").withColumns(_ends(p, F.col("_side"))).select("image_id", "_side", "_n", *_ends(p, F.col("_side")))
    count = lambda a, b: (F.col(b) - F.col(a) + 1).cast("double")
    dealt = many(s, "s_").unionByName(many(d, "d_")).groupBy("image_id", "_side", "_n").agg(F.sum(count("_x0", "_x1") * count("_y0", "_y1")).alias("_rows"))
    sides = written(dealt.where(F.col("_rows") <= CELLS_EACH * F.col("_n")), "sides")
    spread = lambda boxes, p, n: many(boxes, p).withColumn("cx", F.explode(F.sequence("_x0", "_x1"))).withColumn("cy", F.explode(F.sequence("_y0", "_y1"))).groupBy("image_id", "cx", "cy").agg(F.count("*").alias(n))
    meet = spread(s, "s_", "_s").join(spread(d, "d_", "_d"), ["image_id", "cx", "cy"]).groupBy("image_id").agg(F.sum(F.col("_s").cast("double") * F.col("_d")).alias("_met"))
    even = sides.join(meet, "image_id", "left").where(F.coalesce("_met", F.lit(0)) <= CELL_BOXES * F.col("_rows"))
    only = F.array(F.lit(0))
    is_flat = F.col("_even").isNotNull()
    out = known.drop("_side").join(even.select("image_id", F.col("_side").alias("_even")), "image_id", "left")
    return written(out.select("image_id", *[F.when(is_flat, only).otherwise(F.col(c)).alias(c) for c in ("s_levels", "d_levels")], is_flat.alias("is_flat"), F.coalesce("_even", F.lit(cell)).alias("side")), "grids")


def pair_boxes(source: DataFrame, converted: DataFrame, dense: int = DENSE, cell: float = CELL) -> DataFrame:
    """(image_id, s_index, d_index, iou, delta, boxes) of overlapping pairs within an image.

    Images with more than `dense` candidate pairs are told first, by counts alone; they are paired on a grid, all others
    directly.
    """
    return _each_its_way(source, converted, dense, pair_boxes_directly, lambda s, d: pair_on_grid(s, d, cell))


def _each_its_way(source: DataFrame, converted: DataFrame, dense: int, directly: Callable, in_crowds: Callable) -> DataFrame:
    """directly(...) of the images that aren't dense, and in_crowds(...) of those that are, whose boxes are written."""
    found, others = dense_images(source, converted, dense)
    if found.isEmpty():
        return directly(source, converted)
    of_dense = lambda boxes, name: written(boxes.select("image_id", "object_index", *_CORNERS).join(found, "image_id", "left_semi"), name)
    crowds = of_dense(source, "dense_source"), of_dense(converted, "dense_converted")
    freed(found.sparkSession)
    out = in_crowds(*crowds)
    return directly(source.join(found, "image_id", "left_anti"), converted).unionByName(out) if others else out


def match_boxes(pairs: DataFrame, dense: int = DENSE) -> DataFrame:
    """(image_id, s_index, d_index, iou, delta): greedy one-to-one matches, by IoU, then source index, then converted
    index, all descending. The pairs are written and counted; images with more than `dense` of them are matched in rounds.
    """
    rows = written(pairs.select("image_id", "s_index", "d_index", "iou", "delta"), "pairs")
    many = written(rows.groupBy("image_id").count().where(F.col("count") > dense).select("image_id"), "dense_images")
    if many.isEmpty():
        return match_in_order(rows)
    return match_in_order(rows.join(many, "image_id", "left_anti")).unionByName(match_in_rounds(rows.join(many, "image_id", "left_semi")))


def match_image_boxes(source: DataFrame, converted: DataFrame, dense: int = DENSE) -> DataFrame:
    """match_boxes(pair_boxes(source, converted)) with one decision for both steps, by the candidate pairs of an image."""
    return _each_its_way(source, converted, dense, lambda s, d: match_in_order(pair_boxes_directly(s, d)), match_in_bands)


def match_in_bands(source: DataFrame, converted: DataFrame) -> DataFrame:
    """match_boxes of the pairs of images with very many boxes, without making all these pairs: the greedy order takes what
    it takes of a high IoU before it looks at any lower one. So pairs from a first IoU on are made and matched, then pairs
    from a lower one on of the boxes that are left, and at last all of those that then are left.

    In a crowd most pairs are of a small box and a large one that it lies in, with an IoU near 0; boxes with a partner of
    their own size are gone before those are made. Where no box has such a partner, all pairs are made in the end.
    """
    s, d, out = source, converted, None
    for at, least in enumerate(BANDS):
        found = written(match_in_rounds(pair_on_grid(s, d, least=least)), "matches")
        freed(found.sparkSession)
        out = found if out is None else out.unionByName(found)
        if at + 1 < len(BANDS):
            left = lambda boxes, of: boxes.join(found.select("image_id", F.col(of).alias("object_index")), ["image_id", "object_index"], "left_anti")  # noqa: E731, B023
            s, d = written(left(s, "s_index"), "left_source"), written(left(d, "d_index"), "left_converted")
            if s.isEmpty() or d.isEmpty():
                break
    return out


def match_in_order(pairs: DataFrame) -> DataFrame:
    """match_boxes as a fold over the sorted pairs of each image; its time grows with the pairs times the matches of an
    image."""
    ordered = F.sort_array(F.collect_list(F.struct("iou", "s_index", "d_index", "delta")), asc=False)
    per = pairs.groupBy("image_id").agg(ordered.alias("cs"))
    kind = per.schema["cs"].dataType.simpleString()
    taken = F.aggregate("cs", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda m: (m["s_index"] == x["s_index"]) | (m["d_index"] == x["d_index"])), acc).otherwise(F.concat(acc, F.array(x))))
    return per.select("image_id", F.explode(taken).alias("m")).select("image_id", "m.s_index", "m.d_index", "m.iou", "m.delta")


def match_in_rounds(pairs: DataFrame, few: int = FEW) -> DataFrame:
    """match_boxes for images with very many pairs: a pair that comes first among those of both its boxes is one that the
    greedy order takes, whatever happens elsewhere. Each round takes all such pairs at once and drops what their boxes
    still had, by keys (image, box), until none is left.

    A round takes the first pair of each image at least, and as a rule most; where boxes form a long chain in which each
    pair waits for the next, rounds would be many. So once a round takes less than a tenth away, or `few` pairs at most are
    left of all images, what is left is walked in order, image by image.
    """
    left = written(pairs.select("image_id", "s_index", "d_index", "iou", "delta"), "left")
    freed(left.sparkSession)
    n, before, out = left.count(), float("inf"), None
    while n > few and n <= (1 - LEAST_PROGRESS) * before:
        # a struct of an image's pair is greatest where the greedy order comes first
        best = lambda of: left.groupBy("image_id", of).agg(F.max(F.struct("iou", "s_index", "d_index", "delta")).alias("m")).select("image_id", "m.*")  # noqa: E731, B023
        both = best("s_index").join(best("d_index").select("image_id", "s_index", "d_index"), ["image_id", "s_index", "d_index"])
        first = written(both.select("image_id", "s_index", "d_index", "iou", "delta"), "first")
        freed(left.sparkSession)
        out = first if out is None else out.unionByName(first)
        rest = left.join(first.select("image_id", "s_index"), ["image_id", "s_index"], "left_anti").join(first.select("image_id", "d_index"), ["image_id", "d_index"], "left_anti")
        left, before = written(rest, "left"), n
        n = left.count()
        freed(left.sparkSession)
    if out is None:
        return _walk(left)
    return out.unionByName(_walk(left)) if n else out


def _walk(pairs: DataFrame) -> DataFrame:
    """match_boxes by walking the sorted pairs of an image, with the boxes that are taken in two sets."""
    names = ["image_id", "s_index", "d_index", "iou", "delta"]

    def run(batches):
        image, used_s, used_d = None, set(), set()
        for b in batches:
            keep = []
            for at, (i, s, d) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
                if i != image:
                    image, used_s, used_d = i, set(), set()
                if s not in used_s and d not in used_d:
                    used_s.add(s)
                    used_d.add(d)
                    keep.append(at)
            yield b.take(pa.array(keep, pa.int64()))

    rows = pairs.select(*names).repartition("image_id").sortWithinPartitions("image_id", F.desc("iou"), F.desc("s_index"), F.desc("d_index"))
    return rows.mapInArrow(run, rows.schema)


def match_stats(images: DataFrame, source: DataFrame, converted: DataFrame, matches: DataFrame) -> DataFrame:
    """(image_id, source_count, converted_count, min_iou, mean_iou, max_delta, unmatched_source, unmatched_converted)
    for every image. The mean is over the sorted IoUs, so it does not depend on the partitioning."""
    s = source.groupBy("image_id").agg(F.count("*").alias("source_count"))
    d = converted.groupBy("image_id").agg(F.count("*").alias("converted_count"))
    ious = F.sort_array(F.collect_list("iou"))
    m = matches.groupBy("image_id").agg(F.count("*").alias("_n"), F.min("iou").alias("min_iou"), (F.aggregate(ious, F.lit(0.0), lambda a, x: a + x) / F.count("*")).alias("mean_iou"), F.max("delta").alias("max_delta"))
    out = images.select("image_id").join(s, "image_id", "left").join(d, "image_id", "left").join(m, "image_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("image_id", zero("source_count").alias("source_count"), zero("converted_count").alias("converted_count"), "min_iou", "mean_iou", "max_delta", (zero("source_count") - zero("_n")).alias("unmatched_source"), (zero("converted_count") - zero("_n")).alias("unmatched_converted"))
