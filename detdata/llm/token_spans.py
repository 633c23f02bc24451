"""Token counts of fields or sections by offset mapping.

A document is encoded once, whole; its tokens keep the character spans they stand for. Sections are disjoint
character spans of the document in order. Tokens are joined with the sections they overlap; one that crosses a
boundary is allotted by an explicit rule:

    first   to the section that holds its first character
    last    to the section that holds its last character
    most    to the section that holds most of its characters, the first of equals
    split   to each section in proportion to its characters

Characters outside all sections belong to section -1. Tokens of a document are joined inside the task that
encoded it, by binary search in its sections, so no token ever leaves it.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import encoder

RULES = ("first", "last", "most", "split")


def line_sections(text: str) -> np.ndarray:
    """Starts and ends of the lines of a text, line feeds with the line they end."""
    parts = text.split("\n")
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    if len(parts) > 1 and not parts[-1]:
        ends = ends[:-1]
    else:
        ends[-1] -= 1  # no line feed ends it
    return np.array([[0, *ends[:-1]], ends], np.int64)


def allot(start: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> np.ndarray:
    """Tokens (start, end) of a document over its sections (lo, hi): the share of each section, the last entry
    for what is outside."""
    n = len(lo)
    # cells: section i is 2i + 1, the gap before it 2i
    edges = np.empty(2 * n, np.int64)
    edges[0::2], edges[1::2] = lo, hi
    first = np.searchsorted(edges, start, side="right")
    last = np.searchsorted(edges, np.maximum(end - 1, start), side="right")
    cells = np.zeros(2 * n + 1)
    if rule in ("first", "last"):
        np.add.at(cells, first if rule == "first" else last, 1.0)
    else:
        one = first == last
        np.add.at(cells, first[one], 1.0)
        for f, l, s, e in zip(first[~one].tolist(), last[~one].tolist(), start[~one].tolist(), end[~one].tolist(), strict=True):
            cut = np.concatenate([[s], edges[f:l], [e]])
            part = np.diff(cut)
            if rule == "most":
                # all characters outside count as one place
                inside = [(int(p), -c) for c, p in zip(range(f, l + 1), part, strict=True) if c % 2]
                cells[-max(inside)[1] if inside and max(inside)[0] >= part[[c % 2 == 0 for c in range(f, l + 1)]].sum() else 0] += 1.0
            else:
                np.add.at(cells, np.arange(f, l + 1), part / (e - s))
    return np.append(cells[1::2], cells[0::2].sum())


def section_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", sections: Column | None = None, rule: str = "most") -> DataFrame:
    """(doc_id, section, start, stop, n_tokens double): one row for each section of each row of docs, and one
    with section -1 (null start and stop) if tokens are outside all of them.

    sections is a column array<struct<start: int, stop: int>> of disjoint spans in order, in characters (code
    points); left out, the lines are the sections. A null or empty text is one empty line without tokens, a null
    or empty array no section; repeated rows give repeated results; other columns are ignored; an empty table
    gives an empty one. A document's n_tokens sum to its number of tokens.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    src = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *([sections.cast("array<struct<start: bigint, stop: bigint>>").alias("_s")] if sections is not None else []))
    kind = src.schema["_id"].dataType.simpleString()

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            given = b.column(2).to_pylist() if b.num_columns > 2 else None
            for row, _, at, start, end in enc.batch(b.column(1), spans=True):
                ids, number, lows, highs, counts = [], [], [], [], []
                for r in range(len(at) - 1):
                    if given is None:
                        lo, hi = line_sections(b.column(1)[row + r].as_py())
                    else:
                        spans = given[row + r] or []
                        lo, hi = np.array([x["start"] for x in spans], np.int64), np.array([x["stop"] for x in spans], np.int64)
                    shares = allot(start[at[r] : at[r + 1]], end[at[r] : at[r + 1]], lo, hi, rule)
                    n = len(lo)
                    rest = shares[-1] > 0
                    ids.append(np.full(n + rest, row + r))
                    number.append(np.append(np.arange(n), [-1] * int(rest)))
                    lows.append(np.append(lo, [-1] * int(rest)))
                    highs.append(np.append(hi, [-1] * int(rest)))
                    counts.append(shares[: n + rest])
                if not ids:
                    continue
                no = np.concatenate(number).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(ids).astype(np.int64))), pa.array(no), pa.array(np.concatenate(lows).astype(np.int64), mask=no < 0), pa.array(np.concatenate(highs).astype(np.int64), mask=no < 0), pa.array(np.concatenate(counts))], names=["_id", "section", "start", "stop", "n_tokens"])

    out = src.mapInArrow(run, f"_id {kind}, section long, start long, stop long, n_tokens double")
    return out.withColumnRenamed("_id", doc_id)
