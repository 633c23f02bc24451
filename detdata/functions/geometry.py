"""Box arithmetic as Column expressions. A box is four columns: xmin, ymin, xmax, ymax."""

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(prefix + c) for c in ("xmin", "ymin", "xmax", "ymax"))


def box_geometry(b: Box) -> dict[str, Column]:
    w, h = b[2] - b[0], b[3] - b[1]
    return {"box_width": w, "box_height": h, "area": w * h, "aspect": F.when((w > 0) & (h > 0), F.greatest(w / h, h / w))}


def is_small_box(b: Box, side: float) -> Column:
    return ((b[2] - b[0]) <= side) | ((b[3] - b[1]) <= side)


def conversion_error(b: Box, width: Column, height: Column) -> Column:
    """Why a box can't be normalised against the image; null if it can."""
    return (
        F.when((width <= 0) | (height <= 0) | width.isNull() | height.isNull(), "Image dimensions must be positive.")
        .when((b[0] < 0) | (b[1] < 0) | (b[2] <= b[0]) | (b[3] <= b[1]), "Bounding box has negative coordinates or non-positive size.")
        .when((b[2] > width) | (b[3] > height), "Bounding box exceeds actual image dimensions.")
    )


def voc_to_yolo(b: Box, width: Column, height: Column) -> dict[str, Column]:
    """Centre and size as shares of the image, never clamped; null where conversion_error has something."""
    ok = conversion_error(b, width, height).isNull()
    w, h = width.cast("double"), height.cast("double")
    values = {"xc": (b[0] + b[2]) / 2 / w, "yc": (b[1] + b[3]) / 2 / h, "w": (b[2] - b[0]) / w, "h": (b[3] - b[1]) / h}
    return {k: F.when(ok, v) for k, v in values.items()}


def yolo_to_pixels(xc: Column, yc: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    return {"xmin": (xc - w / 2) * width, "ymin": (yc - h / 2) * height, "xmax": (xc + w / 2) * width, "ymax": (yc + h / 2) * height}


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 if the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def coordinate_delta(a: Box, b: Box) -> Column:
    return F.greatest(*[F.abs(x - y) for x, y in zip(a, b, strict=True)])
