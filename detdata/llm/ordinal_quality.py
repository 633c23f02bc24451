"""Quality grades by ordinal cumulative-link regression on hashed text.

Grades 0 < 1 < ... < K-1 share one weight vector: P(grade <= k) = sigmoid(theta_k - s(x)), with ordered
thresholds theta. s is linear in hashed features of the whole text: its distinct words without punctuation, and
the shares of its word shapes (runs of lower case, upper case, digits and each mark).
The model is fitted on at most SAMPLE labelled rows, drawn by hash of the id; its weights (2^BITS floats) are
of fixed size, and every document is scored in one pass.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H

BITS, SAMPLE = 18, 16_384
ROUNDS, RATE, DECAY = 150, 0.1, 2e-4
#: A feature of fewer sampled rows keeps weight 0.
LEAST_ROWS = 8

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_BARE = np.arange(256, dtype=np.uint8)
_BARE[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


def features(column: pa.Array):
    """For each row, in order: its index, feature numbers and values."""
    data, offsets = H.utf8(column)
    top = np.uint64(64 - BITS)
    for i, j in H.slices(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends = H.word_bounds(part, at)
        bare = _BARE[part]  # marks part words, too
        ws, we = H.word_bounds(bare, at)
        words = H.word_hashes(bare, ws, we)
        # shapes: each word without repeats of a class
        kind = _SHAPE[part]
        keep = np.ones(len(kind), dtype=bool)
        keep[1:] = kind[1:] != kind[:-1]
        keep[starts] = True
        new = np.append(0, np.cumsum(keep))
        shapes = H.word_hashes(kind[keep], new[starts], new[ends], fold=False)
        first, word = np.searchsorted(starts, at), np.searchsorted(ws, at)
        for row in range(j - i):
            a, b = first[row], first[row + 1]
            if a == b:
                yield i + row, np.zeros(0, np.int32), np.zeros(0, np.float32)
                continue
            w = H.distinct(words[word[row] : word[row + 1]])
            s, n = np.unique(shapes[a:b], return_counts=True)
            yield i + row, np.concatenate([H.mix(w, 5) >> top, H.mix(s, 6) >> top]).astype(np.int32), np.concatenate([np.full(len(w), 1.0), 6 * np.sqrt(n / (b - a))]).astype(np.float32)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def thresholds(raw: np.ndarray) -> np.ndarray:
    return raw[0] + np.append(0.0, np.cumsum(np.exp(raw[1:])))


def fit(grades: np.ndarray, numbers: list, values: list, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Adam on the mean negative log-likelihood."""
    raw = np.zeros(n_grades - 1)
    w = np.zeros(1 << BITS)
    if not len(grades):
        p = np.arange(1, n_grades) / n_grades
        return w.astype(np.float32), np.log(p / (1 - p))
    # start from the grades' shares
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / len(grades), 1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(np.log(share / (1 - share)) + np.arange(n_grades - 1) * 1e-3)
    raw[0], raw[1:] = theta[0], np.log(np.diff(theta))
    lens = np.array([len(x) for x in numbers])
    col, val, row = np.concatenate(numbers), np.concatenate(values).astype(np.float64), np.repeat(np.arange(len(grades)), lens)
    known = np.bincount(col, minlength=len(w)) >= LEAST_ROWS
    use = known[col]
    col, val, row = col[use], val[use], row[use]
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(raw), np.zeros_like(raw)]
    for step in range(1, ROUNDS + 1):
        s = np.bincount(row, val * w[col], minlength=len(grades))
        theta = thresholds(raw)
        full = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = _sigmoid(full[grades + 1] - s), _sigmoid(full[grades] - s)
        p = np.maximum(hi - lo, 1e-9)
        gs = (1 - hi - lo) / len(grades)
        gw = np.bincount(col, val * gs[row], minlength=len(w)) + DECAY * w
        up, down = -hi * (1 - hi) / p / len(grades), lo * (1 - lo) / p / len(grades)
        gt = np.bincount(grades, up, minlength=n_grades)[:-1] + np.bincount(grades, down, minlength=n_grades)[1:]
        tail = np.cumsum(gt[::-1])[::-1]
        gr = np.append(tail[0], tail[1:] * np.exp(raw[1:]))
        for x, g, m, v in ((w, gw, state[0], state[1]), (raw, gr, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w.astype(np.float32), thresholds(raw)


def train(docs: DataFrame, labels: DataFrame, n_grades: int, doc_id: str, text: str, grade: str, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """The model from at most `sample` labelled rows: they are featurised where they lie and fitted in one task."""
    drawn = labels.where(F.col(grade).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(grade).cast("int").alias("_grade"))
    drawn = drawn.orderBy(F.xxhash64("_id"), "_id", "_grade").limit(sample)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(drawn), "_id").select("_grade", "_text")  # `sample` rows at most

    def featurise(batches):
        for b in batches:
            f = list(features(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for _, x, _ in f], pa.list_(pa.int32())), pa.array([v for _, _, v in f], pa.list_(pa.float32()))], names=["grade", "numbers", "vals"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        w, theta = fit(pdf["grade"].to_numpy().astype(np.int64), list(pdf["numbers"]), list(pdf["vals"]), n_grades)
        return pd.DataFrame({"w": [w.tobytes()], "theta": [theta.tolist()]})

    model = rows.mapInArrow(featurise, "grade int, numbers array<int>, vals array<float>").withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(one, "w binary, theta array<double>").first()
    if model is None:
        return fit(np.zeros(0, np.int64), [], [], n_grades)
    return np.frombuffer(model["w"], np.float32), np.array(model["theta"])


def grade_documents(docs: DataFrame, labels: DataFrame, n_grades: int = 3, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", select_grade: int | None = None, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, expected_grade, tail_prob, kept) for each row of docs: the mean grade, P(grade >= select_grade)
    (the best grade if left out) and whether that is `least` or more.

    labels(doc_id, grade) hold grades 0 to n_grades - 1; rows with a null are not used, repeated ones count each.
    Without any label, all grades are equally likely. A null or empty text has no features; repeated rows score
    alike; other columns are ignored; an empty table gives an empty one.
    """
    at = n_grades - 1 if select_grade is None else select_grade
    w, theta = train(docs, labels, n_grades, doc_id, text, grade, sample)
    src = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()

    def score(batches):
        for b in batches:
            s = np.zeros(b.num_rows)
            for i, numbers, values in features(b.column(1)):
                s[i] = float(np.dot(w[numbers].astype(np.float64), values))
            tails = 1 - _sigmoid(theta[None, :] - s[:, None])  # P(grade > k)
            tail = tails[:, at - 1] if at > 0 else np.ones(len(s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= least)], names=["_id", "expected_grade", "tail_prob", "kept"])

    return src.mapInArrow(score, f"_id {kind}, expected_grade double, tail_prob double, kept boolean").withColumnRenamed("_id", doc_id)
