"""Fill-in-the-middle samples by a two-pass streaming matcher.

A text is a row of units, matches of a pattern from left to right. The first pass runs a lazy match iterator to its
end and counts; two ranks drawn from a hash of the document's id cut the text after so many units. The second pass
advances a fresh iterator to the lower rank, notes where that match ends, and goes on to the higher one. Neither pass
keeps a unit, so a text needs no memory beside itself and the sample made of it, whatever its length.
"""

import hashlib
import re
from collections import deque
from dataclasses import dataclass
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run of letters A-Z, or any one other character.
UNIT = r"[A-Za-z]+|[^A-Za-z]"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Characters of samples that leave a task at once; one sample at least.
SLICE = 4 << 20


@dataclass(frozen=True)
class Marks:
    """What stands before prefix, suffix and middle. No mark may be the beginning of another, nor overlap itself or another, so that the first one found is the one that was put there."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or len(set(marks)) < 3:
            raise ValueError("three different marks, none empty")
        for a in marks:
            for b in marks:
                if any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)) + (a != b))) or (a != b and a in b):
                    raise ValueError(f"marks {a!r} and {b!r} overlap")


def n_units(unit: re.Pattern, text: str) -> int:
    """First pass: how many units the text has."""
    ticks = count()
    deque(zip(unit.finditer(text), ticks, strict=False), maxlen=0)
    return next(ticks)


def cuts(unit: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: the places after `low` and after `high` units, low <= high."""
    matches = unit.finditer(text)
    first = next(islice(matches, low - 1, None)).end() if low else 0
    return first, next(islice(matches, high - low - 1, None)).end() if high > low else first


def draws(seed: int, doc_id: object) -> list[int]:
    """Four unsigned 32-bit integers of a document: the first groups of sha256 of `seed:id`; a null id counts as empty."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, unit: str = UNIT, plain_percent: int = 10, spm_percent: int = 20, marks: Marks | None = None) -> DataFrame:
    """(doc_id, n long, form, prefix_chars, middle_chars long, output): a row for each row of docs.

    n counts the units. Draws h1 to h4 cut the text after the lower and the higher of h1 % (n + 1) and h2 % (n + 1)
    units. The form is plain for an empty text, a text with a mark in it, and plain_percent of the others (h3); of the
    rest spm_percent (h4) are spm, the others psm. Output is the text, prefix mark + prefix + suffix mark + suffix +
    middle mark + middle (psm), or suffix mark + suffix + prefix mark + prefix + middle mark + middle (spm). Lengths are
    in code points, null for plain.

    A null text is empty, a null id an empty id; rows with equal id and text give equal rows; other columns are ignored;
    an empty table gives an empty one. Rows stay where they are read: there is no shuffle.
    """
    m = marks or Marks()
    src = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()

    def sample(key, t: str, pattern: re.Pattern) -> tuple:
        n = n_units(pattern, t)
        h1, h2, h3, h4 = draws(seed, key)
        if not t or any(x in t for x in (m.prefix, m.suffix, m.middle)) or h3 % 100 >= 100 - plain_percent:
            return n, PLAIN, None, None, t
        a, b = h1 % (n + 1), h2 % (n + 1)
        first, second = cuts(pattern, t, min(a, b), max(a, b))
        form = SPM if h4 % 100 < spm_percent else PSM
        parts = (m.prefix, t[:first]), (m.suffix, t[second:])
        out = "".join(x for part in (parts if form == PSM else parts[::-1]) for x in part) + m.middle + t[first:second]
        return n, form, first, second - first, out

    def run(batches):
        pattern = re.compile(unit)
        for b in batches:
            at, rows, held = 0, [], 0
            for i in range(b.num_rows):  # one text at a time leaves Arrow
                rows.append(sample(b.column(0)[i].as_py(), b.column(1)[i].as_py(), pattern))
                held += len(rows[-1][-1])
                if held >= SLICE or i + 1 == b.num_rows:
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(rows)), *columns], names=["_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                    at, rows, held = i + 1, [], 0

    out = src.mapInArrow(run, f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("_id", doc_id)


def restored(form: Column, output: Column, marks: Marks | None = None) -> Column:
    """The text that a sample was made of, from its form and output alone. Built-in functions."""
    m = marks or Marks()

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        # no part holds a mark and no mark overlaps another, so the first one found ends the part
        after = lambda x, taken: F.substring(x, taken + F.lit(1), F.length(x))
        body = after(output, F.lit(len(first)))
        one = F.substring_index(body, second, 1)
        body = after(body, F.length(one) + F.lit(len(second)))
        two = F.substring_index(body, m.middle, 1)
        return one, two, after(body, F.length(two) + F.lit(len(m.middle)))

    prefix, suffix, middle = parts(m.prefix, m.suffix)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(m.suffix, m.prefix)
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(F.concat(prefix, middle, suffix))
