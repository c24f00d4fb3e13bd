"""Quality classifier: naive Bayes support vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Words, fresh, pieces, table

#: Hashed features: words, and runs of three bytes, as indicators.
BITS = 18
#: The fit takes at most about so many labelled rows, those whose hash of the id falls below a share. Documented bound.
FIT_ROWS = 6_000
THRESHOLD = 0.3
HELD_OUT = 5


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each row, rows in order: (row, feature)."""
    words = Words(column)
    word = (words.hash >> np.uint64(64 - BITS)).astype(np.int64)
    keys = [(words.row.astype(np.int64) << BITS) | word]
    data, n = words.data.astype(np.uint32), len(words.data) - 2
    if n > 0:
        three = (data[:n] | (data[1 : n + 1] << np.uint32(8)) | (data[2 : n + 2] << np.uint32(16))) * np.uint32(2654435761)
        row = np.repeat(np.arange(words.rows), np.diff(words.offsets))
        same = row[:n] == row[2 : n + 2]
        keys.append(((row[:n].astype(np.int64) << BITS) | (three >> np.uint32(32 - BITS)).astype(np.int64))[same])
    keys = np.sort(np.concatenate(keys))
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    return keys >> BITS, keys & ((1 << BITS) - 1)


def _feature_rows(batches):
    for whole in batches:
        for batch in pieces(whole, "text"):
            row, feature = features(batch.column("text"))
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            found = [feature[at[k] : at[k + 1]].astype(np.int32).tobytes() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("fold"), pa.array(found, pa.binary())], ["quality", "fold", "features"])


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of the smoothed share of each feature in class 1 over that in class 0."""
    p, q = (np.full(1 << BITS, smooth) for _ in range(2))
    for x, good in zip(rows, y, strict=True):
        (p if good else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows, values, y, cost, epochs=12, seed=7) -> tuple[np.ndarray, float]:
    """Weights of a linear hinge-loss model; one dual variable per row, boxed by its class's cost."""
    w, b, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    square = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + b) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                b += step
                alpha[i] = new
    return w, b


def _platt(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins, by Newton steps with a little ridge."""
    t = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (t - p) - 1e-3 * (theta - [1.0, 0.0]))
        theta += step
        if abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


class Model:
    """ratio * weight per feature in one array, an offset, and the logistic curve."""

    def __init__(self, product, ratio, offset, slope, shift):
        self.product, self.ratio, self.offset, self.slope, self.shift = product.astype(np.float32), ratio.astype(np.float32), offset, slope, shift

    def score(self, column: pa.Array) -> np.ndarray:
        row, feature = features(column)
        n = len(column)
        dot = np.bincount(row, self.product[feature].astype(np.float64), n)
        norm = np.sqrt(np.bincount(row, self.ratio[feature].astype(np.float64) ** 2, n))
        margin = dot / np.where(norm > 0, norm, 1) + self.offset
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """Fit on rows with a label and outside the held-out fold; None if a class has no rows.

    The bounded sample is chosen by a hash of the id alone (of labels that many documents
    with one id share, each document counts). Five sixths of it fit the
    ratios and weights, the rest the curve. A document with several labels counts
    with the lowest; null labels don't count.
    """
    usable = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    usable = usable.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT != 0)
    n = usable.count()
    mark = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000))
    sample = usable.where(mark < int(1_000_000 * min(1.0, fit_rows / max(n, 1)))).select(
        F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"),
        F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(6)).cast("int").alias("fold"),
    )
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))  # about fit_rows rows
    got = joined.select("quality", "fold", "text", "doc_id").mapInArrow(_feature_rows, "quality int, fold int, features binary").toArrow()
    x = [np.frombuffer(v.as_py(), np.int32) for v in got.column("features")]
    good, fold = np.array(got.column("quality").to_pylist(), dtype=np.int64) == 1, np.array(got.column("fold").to_pylist(), dtype=np.int64)
    order = sorted(range(len(x)), key=lambda i: (fold[i], good[i], len(x[i]), x[i].tobytes()))
    x, good, fold = [x[i] for i in order], good[order], fold[order]
    train = fold > 0 if good[fold > 0].any() and (~good[fold > 0]).any() else np.ones(len(x), bool)
    if not len(x) or good[train].all() or not good[train].any():
        return None
    rows = [v for v, t in zip(x, train, strict=True) if t]
    ratio = log_count_ratio(rows, good[train])
    values = [ratio[v] / (np.linalg.norm(ratio[v]) or 1.0) for v in rows]
    cost = np.where(good[train], len(rows) / (2 * good[train].sum()), len(rows) / (2 * (~good[train]).sum()))
    w, b = dual_coordinate_descent(rows, values, np.where(good[train], 1.0, -1.0), cost)
    held = ~train if good[~train].any() and (~good[~train]).any() else train
    margin = np.array([w[v] @ ratio[v] / (np.linalg.norm(ratio[v]) or 1.0) + b for v, h in zip(x, held, strict=True) if h])
    slope, shift = _platt(margin, good[held])
    return Model(ratio * w, ratio, b, slope, shift)


def score(docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """``docs`` with one more column, 0 to 1; higher: good text likelier.

    Null and empty texts have no features and get the score of the offset; without
    a model (a class has no rows) every score is 0.5. Texts of any length are read
    whole. Repeated rows are scored alike; rows don't depend on each other, so there are
    no ties. An empty table gives an empty result. A column of the new one's name is
    replaced, others are kept.
    """
    keep = [c for c in docs.columns if c.lower() != column.lower()]
    schema = docs.select(keep).schema.add(column, "double")
    text = [c.lower() for c in keep].index("text")

    def scored(batches):
        for whole in batches:
            for batch in pieces(whole, text):
                value = model.score(batch.column(text)) if model else np.full(batch.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], schema.fieldNames())

    return docs.select(keep).mapInArrow(scored, schema)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the classifier doesn't reject, with all their columns, whatever their names.

    Null and empty texts are judged by the offset. Rows on the threshold stay, and
    so do all rows if a class has no labelled rows. Texts of any length are read whole;
    repeated rows are judged alike. An empty table gives an empty result.
    """
    (column,) = fresh(docs.columns, "_score")
    return score(docs, fit(docs, labels), column).where(F.col(column) >= threshold).drop(column)


def op9_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
