"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, Words, fresh, mix, pieces, table

#: Positions of a window that are hashed, 1, or ignored, 0. Every overlap that counts has four equal words in a row
#: or, if no run is longer than three, two runs of two or three beside one differing word; so with an item of 6 words or
#: more it has a window of one of these. Shorter items need the masks of their length, too.
MASKS = ("1111", "11011")
SHORT = {"1": 1, "11": 2, "111": 3, "10111": 5, "11101": 5}
#: Of an overlap that counts, a part of at most 29 words counts; it lies so far before and after the start of its window,
#: or of the first of a run of windows on one diagonal. A run of 12 equal words counts by itself, a shorter one has 9 windows.
BEFORE, AFTER = 25, 38
#: Windows that are compared with the benchmark at once, about.
HITS = 200_000
#: An overlap counts from so many equal words, or this share of a shorter item.
MIN_WORDS, SHARE = 12, 0.8
#: Words of an overlap that must be equal: so many of so many.
EQUAL, OF = 4, 5
#: Benchmark text that one pass over the documents takes; more makes more passes.
BLOCK_BYTES = 4 << 20
FILTER_BITS = 22


def _seeds(words: Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    span, n = len(mask), len(words.start) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.full(n, int(mask, 2), np.uint64)
    for j, used in enumerate(mask):
        if used == "1":
            out = (out + words.hash[j : j + n]) * np.uint64(0xD6E8FEB86659FD93)
    at = np.flatnonzero(words.row[:n] == words.row[span - 1 : span - 1 + n])
    return at, mix(out[at])


def _stretch(same: np.ndarray) -> tuple[int, int, int]:
    """Begin, end and equal words of the stretch with the most equal words of those where EQUAL of OF words are equal."""
    equal = np.concatenate(([0], np.cumsum(same)))
    spare = OF * equal - EQUAL * np.arange(len(equal))
    # for each end the first begin that leaves enough words equal: there spare is no higher
    begin = np.searchsorted(-np.minimum.accumulate(spare), -spare, "left")
    end = int(np.argmax(equal - equal[begin]))
    begin, most = int(begin[end]), int(equal[end] - equal[begin[end]])
    return begin + int(np.argmax(same[begin:end])) if most else begin, end, most


def _by_place(words: Words, mask: str) -> np.ndarray:
    """The seed hash of the window that starts at each word, 0 where none does."""
    out = np.zeros(len(words.start), np.uint64)
    at, h = _seeds(words, mask)
    out[at] = h
    return out


class Seeds:
    """The seed hashes of a block of benchmark items, with a bit filter before the exact lookup."""

    def __init__(self, ids: list, texts: list):
        self.ids = ids
        self.words = Words(pa.array(texts, pa.string()), lower=True)
        length = np.diff(self.words.first)
        self.need = np.array([min(MIN_WORDS, math.ceil(SHARE * n)) for n in length.tolist()], np.int64)
        self.exact = self.need == length
        self.masks = [*MASKS, *(m for m, n in SHORT.items() if n in length)]
        hashes, places = [], []
        for mask in self.masks:
            at, h = _seeds(self.words, mask)
            if mask in SHORT:
                fits = length[self.words.row[at]] == SHORT[mask]
                at, h = at[fits], h[fits]
            hashes.append(h)
            places.append(at)
        hashes, places = np.concatenate(hashes), np.concatenate(places)
        order = np.argsort(hashes, kind="stable")
        self.hash, self.place = hashes[order], places[order]
        self.by_mask = {mask: _by_place(self.words, mask) for mask in MASKS}
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.hash >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def _begins(self, docs: Words, mask: str, own: np.ndarray, where: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which windows have no like window right before them on their diagonal, so that a run is looked at once."""
        item = self.by_mask[mask]
        w, p = np.maximum(where - 1, 0), np.maximum(place - 1, 0)
        goes_on = (docs.row[w] == docs.row[where]) & (self.words.row[p] == self.words.row[place]) & (where > 0) & (place > 0)
        return ~(goes_on & (own[w] == item[p]) & (own[w] != 0))

    def _likely(self, docs: Words, where: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which windows have as many equal words around them, on their diagonal, as an overlap with the item needs."""
        row, item = docs.row[where], self.words.row[place]
        lo = np.maximum(docs.first[row] - where, self.words.first[item] - place)
        hi = np.minimum(docs.first[row + 1] - where, self.words.first[item + 1] - place)
        equal = np.zeros(len(where), np.int64)
        for k in range(-BEFORE, AFTER):
            inside = np.flatnonzero((lo <= k) & (k < hi))
            equal[inside] += docs.hash[where[inside] + k] == self.words.hash[place[inside] + k]
        return equal >= self.need[item]

    def overlaps(self, column: pa.Array):
        """(row, item, equal words, words of the overlap, first word) of each overlap that counts, the best of each row and item."""
        docs = Words(column, lower=True)
        row, item, shift = [], [], []
        for mask in self.masks:
            at, h = _seeds(docs, mask)
            own = _by_place(docs, mask) if mask in self.by_mask else None
            near = self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
            at, h = at[near], h[near]
            lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            n = np.cumsum(hi - lo)
            k = 0
            while k < len(at):
                to = max(k + 1, int(np.searchsorted(n, (n[k - 1] if k else 0) + HITS, "right")))
                size = (hi - lo)[k:to]
                where = np.repeat(at[k:to], size)
                place = self.place[np.repeat(lo[k:to] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                if own is not None:
                    first = self._begins(docs, mask, own, where, place)
                    where, place = where[first], place[first]
                good = self._likely(docs, where, place)
                where, place = where[good], place[good]
                row.append(docs.row[where])
                item.append(self.words.row[place])
                shift.append((where - docs.first[docs.row[where]]) - (place - self.words.first[self.words.row[place]]))
                k = to
        if not row:
            return []
        found = np.unique(np.stack([np.concatenate(row), np.concatenate(item), np.concatenate(shift)]), axis=1)
        first = np.ones(found.shape[1], bool)
        first[1:] = (found[:2, 1:] != found[:2, :-1]).any(axis=0)
        found = found[:, first | ~self.exact[found[1]]]  # an item that counts only whole is the same everywhere
        best: dict = {}
        for r, i, d in found.T.tolist():
            a0, a1 = docs.first[r], docs.first[r + 1]
            b0, b1 = self.words.first[i], self.words.first[i + 1]
            lo, hi = max(0, -d), min(b1 - b0, a1 - a0 - d)
            same = docs.hash[a0 + d + lo : a0 + d + hi] == self.words.hash[b0 + lo : b0 + hi]
            begin, end, equal = _stretch(same)
            if equal >= self.need[i]:
                best[r, i] = max(best.get((r, i), (0, 0, 0)), (equal, end - begin, -int(d + lo + begin)))
        return [(r, i, e, n, -f) for (r, i), (e, n, f) in sorted(best.items())]


def _blocks(benchmark: DataFrame) -> Iterator[Seeds]:
    """Benchmark items in blocks of bounded size, each collected for one pass over the documents.

    Who needs more than one lets go of each before the next.
    """
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("s")).first()["s"]
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()
        yield Seeds(rows.column("item_id").to_pylist(), rows.column("text").to_pylist())


def _passes(docs: DataFrame, benchmark: DataFrame, made, schema) -> DataFrame:
    """The rows that ``made(block)`` finds in the documents, block after block; of several passes each is written."""
    blocks = _blocks(benchmark)
    block, scratch, out = next(blocks), None, None
    while block is not None:
        part, block = docs.mapInArrow(made(block), schema), next(blocks, None)
        if block is not None or out is not None:  # the block goes with its pass
            scratch = scratch or Scratch(docs.sparkSession)
            part = scratch.save(part)
        out = part if out is None else out.unionByName(part)
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, equal_words, overlap_words, first_word, item_words): the best overlap of each document and item that share one.

    Words are split at white space and A-Z lower-cased. The seed hashes of documents
    are joined with those of the items, held in a table, under each mask; a pair lies on one
    diagonal, and every overlap that counts has such a pair, whatever the length of the
    item. Along the diagonal, of all stretches where 80% of the words are equal, the one
    with the most equal words is found. It counts with at least 12 equal words (of short
    items 80%, so one of 1 to 4 words counts wherever it stands whole). Of overlaps with as
    many equal words the longest counts, then the first.

    Null and empty texts and items share nothing. Texts of any length are read whole.
    Repeated rows and items each give their rows. An empty table gives an empty result;
    other columns are left out. The benchmark is a query set: it is held in blocks of 4
    MB, with one pass over all documents for each.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    names = ["doc_id", "item_id", "equal_words", "overlap_words", "first_word", "item_words"]

    def made(block):
        def found(batches):
            for whole in batches:
                for batch in pieces(whole, "text"):
                    rows = block.overlaps(batch.column("text"))
                    if rows:
                        r, i, e, n, f = map(list, zip(*rows, strict=True))
                        length = np.diff(block.words.first)[i]
                        ids = [batch.column("doc_id").take(pa.array(r)), pa.array([block.ids[x] for x in i], pa.int64())]
                        yield pa.RecordBatch.from_arrays([*ids, *(pa.array(x, pa.int64()) for x in (e, n, f, length))], names)

        return found

    return _passes(docs, benchmark, made, ", ".join(f"{x} long" for x in names))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that share no overlap with a benchmark item, with all their columns, whatever their names.

    What counts as an overlap, ties, nulls, empty and long texts are as in ``overlaps``;
    repeated rows go or stay together, and an empty table gives an empty result. A
    benchmark of more than one block marks texts by digest, and these are taken out.
    """
    text = [c.lower() for c in docs.columns].index("text")
    blocks = _blocks(benchmark)
    block, more = next(blocks), next(blocks, None)
    if more is None:

        def clean(batches):
            for whole in batches:
                for batch in pieces(whole, text):
                    keep = np.ones(batch.num_rows, bool)
                    keep[[r for r, *_ in block.overlaps(batch.column(text))]] = False
                    yield batch.filter(pa.array(keep))

        return docs.mapInArrow(clean, docs.schema)
    del block, more, blocks
    digest = F.sha2(F.col("text"), 256)
    (mark,) = fresh(docs.columns, "_digest")

    def made(block):
        def marked(batches):
            for whole in batches:
                for batch in pieces(whole, "text"):
                    hit = sorted({r for r, *_ in block.overlaps(batch.column("text"))})
                    yield pa.RecordBatch.from_arrays([batch.column("digest").take(pa.array(hit, pa.int64()))], ["digest"])

        return marked

    found = _passes(docs.select("text", digest.alias("digest")), benchmark, made, "digest string").distinct()
    found = Scratch(docs.sparkSession).save(found.withColumnRenamed("digest", mark))
    return docs.join(found, digest == found[mark], "left_anti")


def op2_benchmark_decontamination(spark, sf_dir):
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
