"""Quality rules: an isolation forest on rule statistics, its thresholds from labelled rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import Scratch, Words, mix, pieces, table

#: Characters that the rule on symbols counts.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Trees, and rows that each is grown from; the rows come from a sample of about so many labelled rows. Documented bound.
TREES, TREE_ROWS, FIT_ROWS = 256, 256, 8_192
#: Of the labelled good rows of a band of lengths at most this share may be taken for anomalies.
GOOD_LOST = 0.01
#: Bands by number of words, each with its own threshold: statistics of short texts scatter more.
BANDS = (100, 300, 1_000)
#: A band has a threshold of its own if it has so many labelled rows of either class.
BAND_ROWS = 30
#: Scores are counted in so many steps; the counts are what reaches the driver.
STEPS = 2_000
HELD_OUT = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "n_same_words"]
#: What the forest looks at. Repeated lines, repeated passages and digits are left out: clean lists, refrains and numbers have them,
#: and the base rules judge repetition already.
FEATURES = ["word_length", "symbol_share", "capital_share", "mark_share", "same_word_share"]
#: Shares are taken as if a text had so many more words without any of it, of so many characters, and on a scale that begins at this share.
MORE_WORDS, MORE_CHARS, FLOOR = 50, 250, 0.01


def _kinds() -> dict[str, np.ndarray]:
    at = np.arange(256)
    letter = ((at >= 65) & (at <= 90)) | ((at >= 97) & (at <= 122))
    digit = (at >= 48) & (at <= 57)
    space = (at == 32) | ((at >= 9) & (at <= 13))
    symbol = np.isin(at, np.frombuffer(SYMBOLS, np.uint8))
    return {
        "space": space, "symbol": symbol, "capital": (at >= 65) & (at <= 90),
        "mark": (at > 32) & (at < 127) & ~letter & ~digit & ~symbol, "lead": (at & 0xC0) != 0x80,
    }


KINDS = _kinds()
_U = np.uint64


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of the bytes of each span, from two sums in different bases of prefixes, so that equal bytes give equal numbers."""
    out = np.zeros(len(start), np.uint64)
    for base in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        power = np.full(len(data) + 1, base, np.uint64)
        power[:1] = 1
        np.cumprod(power, out=power)
        undo = np.full(len(data) + 1, pow(base, -1, 1 << 64), np.uint64)
        undo[:1] = 1
        np.cumprod(undo, out=undo)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + _U(1)) * power[:-1], dtype=np.uint64)))
        out = mix(out + (total[end] - total[start]) * undo[start] + (end - start).astype(np.uint64))
    return out


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text, from its bytes: words, their code points, symbols, repeated lines and words, kinds of characters."""
    w = Words(column)
    n, row = w.rows, w.row
    of_row = lambda flags: np.diff(np.concatenate((np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)))[w.offsets])
    out = {"n_words": np.diff(w.first)}
    out["word_chars"] = of_row(KINDS["lead"][w.data]) - of_row(KINDS["space"][w.data])
    out["n_symbols"] = of_row(KINDS["symbol"][w.data])
    for name, kind in (("n_capitals", "capital"), ("n_marks", "mark")):
        out[name] = of_row(KINDS[kind][w.data])
    # lines with a word: each word belongs to the line that its byte is in
    breaks = np.union1d(w.offsets[:-1], np.flatnonzero(w.data == 10) + 1)
    line = np.unique(np.searchsorted(breaks, w.start, side="right") - 1)
    start = breaks[line]
    of = np.searchsorted(w.offsets, start, side="right") - 1
    after = np.append(breaks, len(w.data))[line + 1]
    end = after - (w.data[after - 1] == 10)  # without its \n
    out["n_dup_lines"] = np.bincount(_again(of, _span_hashes(w.data, start, end)), minlength=n) if len(of) else np.zeros(n, np.int64)
    # words of three-word windows that a text has twice or more
    at, h = w.grams(3)
    repeated = np.zeros(len(w.start) + 3, bool)
    if len(at):
        order = np.lexsort((h, row[at]))
        same = (h[order][1:] == h[order][:-1]) & (row[at][order][1:] == row[at][order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            repeated[at[twice] + k] = True
    out["n_repeat_words"] = np.bincount(row[repeated[: len(row)]], minlength=n)
    next_ = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
    out["n_same_words"] = np.bincount(row[1:][next_], minlength=n)
    return {k: out[k].astype(np.int64) for k in COUNTS}


def _again(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The row of each entry whose key an earlier entry of the row has."""
    order = np.lexsort((key, row))
    same = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    return row[order[1:][same]]


def shares(counts: dict[str, np.ndarray]) -> np.ndarray:
    """FEATURES of each row, on a logarithmic scale; a short text's shares are drawn towards none."""
    words, chars = counts["n_words"] + MORE_WORDS, counts["word_chars"] + MORE_CHARS
    share = lambda name, of: np.log(counts[name] / of + FLOOR)
    return np.stack([
        np.log((counts["word_chars"] + 1) / (counts["n_words"] + 1)), share("n_symbols", words), share("n_capitals", chars),
        share("n_marks", words), share("n_same_words", words),
    ], 1)


def _with_counts(batches):
    for whole in batches:
        for batch in pieces(whole, 1):
            found = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[k]) for k in COUNTS]], ["doc_id", *COUNTS])


def expected_path(n) -> np.ndarray:
    """Mean path to an empty place in a binary search tree of n rows, by which paths are measured."""
    n = np.asarray(n, np.float64)
    many = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(many - 1) + np.euler_gamma) - 2 * (many - 1) / many, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees over a matrix: random features, random splits between their ends, down to a depth of log2 of the rows."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 11):
        rng = np.random.default_rng(seed)
        rows = min(rows, len(x))
        self.depth = max(1, math.ceil(math.log2(max(rows, 2))))
        self.unit = float(expected_path(rows)) or 1.0
        self.feature, self.split, self.left, self.value, self.root = [], [], [], [], []
        for _ in range(trees):
            self._grow(x[rng.choice(len(x), rows, replace=False)], rng)
        self.feature, self.left = np.array(self.feature, np.int32), np.array(self.left, np.int32)
        self.split, self.value, self.root = np.array(self.split), np.array(self.value), np.array(self.root)

    def _node(self) -> int:
        for column, value in ((self.feature, 0), (self.split, 0.0), (self.left, -1), (self.value, 0.0)):
            column.append(value)
        return len(self.left) - 1

    def _grow(self, x: np.ndarray, rng) -> None:
        self.root.append(self._node())
        todo = [(self.root[-1], x, 0)]
        while todo:
            at, some, depth = todo.pop()
            lo, hi = some.min(0), some.max(0)
            open_ = np.flatnonzero(hi > lo)
            if depth == self.depth or not len(open_):
                self.value[at] = depth + float(expected_path(len(some)))
                continue
            f = int(rng.choice(open_))
            cut = rng.uniform(lo[f], hi[f])
            below = some[:, f] <= cut
            self.feature[at], self.split[at] = f, cut
            self.left[at] = self._node()
            self._node()  # the right child stands behind the left one
            todo += [(self.left[at], some[below], depth + 1), (self.left[at] + 1, some[~below], depth + 1)]

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row over all trees."""
        out = np.zeros(len(x))
        for at in range(0, len(x), 4_096):
            some = x[at : at + 4_096]
            node = np.repeat(self.root[None], len(some), 0)
            row = np.arange(len(some))[:, None]
            for _ in range(self.depth):
                left = self.left[node]
                right = some[row, self.feature[node]] > self.split[node]
                node = np.where(left >= 0, left + right, node)
            out[at : at + 4_096] = self.value[node].mean(1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 to the power of minus the path as a share of the expected one: near 1 for rows that few splits set apart."""
        return 2.0 ** (-self.paths(x) / self.unit)


def _band(words: Column) -> Column:
    out = F.lit(0)
    for b in BANDS:
        out = out + (words >= b).cast("int")
    return out


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def counted(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id and COUNTS of each row, written: texts are read once."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scratch.save(slim.mapInArrow(_with_counts, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS)))


def _scored(forest: Forest, columns: list[str]):
    def work(batches):
        for batch in batches:
            found = {k: batch.column(k).to_numpy() for k in COUNTS}
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(forest.scores(shares(found)))], [*columns, "anomaly"])

    return work


def scored(counts: DataFrame, forest: Forest) -> DataFrame:
    """``counts`` with the anomaly of each row."""
    return counts.mapInArrow(_scored(forest, counts.columns), T.StructType([*counts.schema.fields, T.StructField("anomaly", T.DoubleType())]))


def _labelled(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with a label outside the held-out fold that the base rules let pass; of several labels the lowest."""
    usable = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").cast("int").alias("quality"))
    usable = usable.where(F.crc32(F.col("_id").cast("string").cast("binary")) % HELD_OUT != 0)
    return counts.where(~base_failed()).join(usable, F.col("doc_id") == F.col("_id")).drop("_id")


def grown(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Forest | None:
    """A forest from about ``fit_rows`` labelled rows, chosen by a hash of their ids and numbers; None without rows."""
    n = labelled.count()
    mark = F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(1_000_000))
    got = labelled.where(mark < int(1_000_000 * min(1.0, fit_rows / max(n, 1)))).select(*COUNTS).toArrow()  # about fit_rows rows
    x = shares({k: got.column(k).to_numpy() for k in COUNTS})
    x = x[np.lexsort(x.T)]  # no matter in which order rows came
    return Forest(x) if len(x) else None


def _threshold(good: np.ndarray, bad: np.ndarray, good_lost: float) -> float:
    """The score from which on rows are anomalies: of those that lose no more good rows than allowed, that with the least balanced error; the greatest of equal ones."""
    lost, found = (np.cumsum(x[::-1])[::-1] / max(x.sum(), 1) for x in (good, bad))  # by the least step that is called an anomaly
    balance = np.where(lost <= good_lost, lost + 1 - found, np.inf)
    best = len(balance) - 1 - int(np.argmin(balance[::-1]))
    return best / STEPS if balance[best] < 1 else 2.0


def thresholds(labelled: DataFrame, forest: Forest, good_lost: float = GOOD_LOST) -> list[float]:
    """One for each band, from the scores of all labelled rows; a class or a band without enough of them takes the one of all bands."""
    step = F.least(F.floor(F.col("anomaly") * STEPS), F.lit(STEPS - 1)).cast("int")
    cells = scored(labelled.select("doc_id", *COUNTS, "quality"), forest)
    cells = cells.groupBy(_band(F.col("n_words")).alias("band"), step.alias("step"), (F.col("quality") == 1).alias("good")).count().collect()
    count = np.zeros((2, len(BANDS) + 1, STEPS))  # at most this many cells
    for r in cells:
        count[int(r["good"]), r["band"], r["step"]] += r["count"]
    if not count[0].sum() or not count[1].sum():
        return [2.0] * (len(BANDS) + 1)
    whole = _threshold(count[1].sum(0), count[0].sum(0), good_lost)
    own = [min(count[0, b].sum(), count[1, b].sum()) >= BAND_ROWS for b in range(len(BANDS) + 1)]
    return [_threshold(count[1, b], count[0, b], good_lost) if own[b] else whole for b in range(len(BANDS) + 1)]


def verdicts(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, good_lost: float = GOOD_LOST) -> DataFrame:
    """doc_id, COUNTS, base_failed, anomaly, threshold and kept of every row of ``docs``.

    A forest of isolation trees over shares of the statistics (``FEATURES``), grown from a
    bounded sample of labelled rows, gives short paths to rows that are unlike most.
    The thresholds are calibrated on the scores of all labelled rows outside the
    held-out fold, by bands of length, so that at most ``good_lost`` of the good ones go.

    Null and empty texts have no words and fail the base rules. Rows without a label, and
    of null doc_id, are judged like others. Of several labels of a document the lowest
    counts, null ones don't. Rows on the threshold go. Without labelled rows of both classes no row is
    an anomaly, and the base rules alone decide. Texts of any length are read whole; repeated rows are
    judged alike. An empty table gives an empty result. Other columns are left out,
    whatever their names. Lines and windows are compared by 64-bit hashes within a text.
    """
    scratch = Scratch(docs.sparkSession)
    counts = counted(docs, scratch)
    labelled = scratch.save(_labelled(counts, labels))
    forest = grown(labelled, fit_rows)
    if forest is None:
        out = counts.withColumn("anomaly", F.lit(0.0))
        marks = [2.0] * (len(BANDS) + 1)
    else:
        marks = thresholds(labelled, forest, good_lost)
        out = scored(counts, forest)
    scratch.drop(labelled)
    threshold = F.element_at(F.array(*[F.lit(float(x)) for x in marks]), _band(F.col("n_words")) + 1)
    out = out.withColumn("base_failed", base_failed()).withColumn("threshold", threshold)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.col("threshold")))


def op13_quality_rules(spark, sf_dir):
    """Verdicts on all ``documents``; nulls, ties and repeated rows as in ``verdicts``."""
    out = verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", "anomaly", "threshold")
