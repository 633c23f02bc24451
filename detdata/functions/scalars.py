"""Scalar helpers as Column expressions (all run inside generated code)."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_name(path: Column) -> Column:
    """Last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def path_stem(path: Column) -> Column:
    """Name without its suffix; a name that only begins with a dot has no suffix."""
    return F.regexp_replace(path_name(path), r"(?<=.)\.[^.]+$", "")


def path_suffix(path: Column) -> Column:
    """Lower-case suffix without the dot, empty if there is none."""
    return F.lower(F.regexp_extract(path_name(path), r"^.+\.([^.]+)$", 1))


def xml_text(value: Column) -> Column:
    """Trimmed text; absent stays null and blank stays empty."""
    return F.trim(value)


_NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"


def parse_number(value: Column) -> Column:
    """A finite number from text, else null. Only plain decimal text counts: nan, inf and type suffixes do not."""
    number = F.when(value.rlike(_NUMBER), F.regexp_replace(value, "[_\\s]", "")).try_cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def parse_positive_integer(value: Column) -> Column:
    """A positive whole number from text (20 and 20.0), else null."""
    n = parse_number(value)
    return F.when((n > 0) & (n == F.floor(n)) & (n <= 2**53), n.cast("bigint"))


def parse_strict_int(value: Column) -> Column:
    """A whole number written without a point, else null."""
    return F.when(value.rlike(r"^\s*[+-]?\d+(_\d+)*\s*$"), F.regexp_replace(value, "[_\\s]", "")).try_cast("bigint")


def is_absolute_path(value: Column) -> Column:
    """A path from the root or from a drive letter."""
    return value.startswith("/") | value.rlike(r"^[A-Za-z]:[\\/]")


def content_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def map_class(name: Column, mapping: dict[str, int]) -> Column:
    """Project class id of a source class, null for any other."""
    return reduce(lambda acc, kv: F.when(name == kv[0], F.lit(kv[1])).otherwise(acc), mapping.items(), F.lit(None).cast("int"))


def join_reasons(*reasons: Column) -> Column:
    """Array of the reasons that are not null, in the given order."""
    return F.array_compact(F.array(*reasons))


def reasons_text(reasons: Column) -> Column:
    return F.array_join(reasons, ";")


def split_reasons(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda r: F.trim(r) != "")


def six_decimals(x: Column) -> Column:
    """Report text of a number; empty for null, which format_string writes as a word."""
    return F.when(x.isNull(), "").otherwise(F.format_string("%.6f", x))


def seeded_order(seed: int, key: Column) -> Column:
    """A repeatable random order: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key))
