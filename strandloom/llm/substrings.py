"""Substring deduplication with repeated-phrase automata."""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, Words, mix, pieces, table

WINDOW = 13
#: A window belongs to its least run of so many words, its anchor; equal windows have equal anchors.
ANCHOR = 5
#: Segments that one automaton is compiled from, at most about so many.
SHARD_SEGMENTS = 20_000
#: An anchor with more different passages than this is left out of the automata; its windows are grouped one by one.
HOT = 1_000
#: Different characters; an automaton over more different words takes two for each.
SYMBOLS = 1_112_063
#: Stands for the owner of a window that only one document has.
NONE = int(np.iinfo(np.int64).max)


def _anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and anchor hash of every window."""
    at, _ = words.grams(window)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    short = np.full(len(words.start), np.iinfo(np.uint64).max, np.uint64)
    where, h = words.grams(anchor)
    short[where] = h
    reach = window - anchor + 1
    low, width = short, 1
    while width < reach:
        step = min(width, reach - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    return at, low[at]


def _anchor_rows(window: int, anchor: int):
    def made(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                words = Words(batch.column("text"))
                at, low = _anchors(words, window, anchor)
                row = words.row[at]
                new = np.ones(len(at), bool)
                new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
                text = np.asarray(batch.column("tid"))[row[new]]
                yield pa.RecordBatch.from_arrays([pa.array(low[new].astype(np.int64)), pa.array(text)], ["anchor", "tid"])

    return made


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Strings of byte ranges of one buffer."""
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size)))
    index = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[index])])


def _spaced(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each, and where each begins and ends."""
    size = words.end - words.start + 1
    offsets = np.concatenate(([0], np.cumsum(size)))
    index = np.repeat(words.start - offsets[:-1], size) + np.arange(offsets[-1])
    data = words.data[np.minimum(index, max(len(words.data) - 1, 0))].copy()
    data[offsets[1:] - 1] = 32
    return data, offsets[:-1], offsets[1:] - 1


def _segments(window: int, anchor: int):
    """Runs of windows with one anchor that stands in several documents: anchor, place, and the words."""

    def made(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                words = Words(batch.column("text"))
                at, low = _anchors(words, window, anchor)
                row, low = words.row[at], low.astype(np.int64)
                lists = batch.column("anchors")
                owner = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.list_value_length(lists)))
                flagged = np.asarray(lists.flatten())
                both = np.concatenate([row, owner]), np.concatenate([low, flagged])
                order = np.lexsort((both[1], both[0]))
                new = np.ones(len(order), bool)
                new[1:] = (both[0][order][1:] != both[0][order][:-1]) | (both[1][order][1:] != both[1][order][:-1])
                number = np.empty(len(order), np.int64)
                number[order] = np.cumsum(new)
                marked = np.zeros(number.max(initial=0) + 1, bool)
                marked[number[len(row) :]] = True
                good = np.flatnonzero(marked[number[: len(row)]])
                if not len(good):
                    continue
                fresh = np.ones(len(good), bool)
                fresh[1:] = (good[1:] != good[:-1] + 1) | (low[good[1:]] != low[good[:-1]]) | (row[good[1:]] != row[good[:-1]])
                first = np.flatnonzero(fresh)
                last = np.append(first[1:], len(good)) - 1
                data, begin, end = _spaced(words)
                lo, hi = at[good[first]], at[good[last]] + window - 1
                for k in range(0, len(lo), 50_000):
                    a, b = lo[k : k + 50_000], hi[k : k + 50_000]
                    r = words.row[a]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(low[good[first[k : k + 50_000]]]), pa.array(np.asarray(batch.column("doc_id"))[r]),
                        pa.array((a - words.first[r]).astype(np.int32)), _slices(data, begin[a], end[b]),
                        *(pa.array(np.asarray(batch.column(c))[r]) for c in ("tid", "crc")),
                    ], ["anchor", "doc_id", "pos", "phrase", "tid", "crc"])

    return made


def _letters(ids: np.ndarray, words: int) -> tuple[np.ndarray, int]:
    """Word numbers as characters, one for each word, or two if there are more words than characters."""
    wide = 1 if words <= SYMBOLS else 2
    codes = ids if wide == 1 else np.stack([ids // SYMBOLS, ids % SYMBOLS], 1).ravel()
    return np.where(codes + 1 < 0xD800, codes + 1, codes + 0x801).astype("<u4"), wide  # not the surrogates


def _confirmed(ids: np.ndarray, passage: np.ndarray, window: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of all passages those that several documents have: one place of each, and its smallest document.

    Windows are told apart by 128 bits of their words' numbers, sorted; no table of windows is held.
    """
    n = len(ids) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(passage[:n] == passage[window - 1 :])
    prints = []
    for salt in (1, 2):
        word = mix(ids.astype(np.uint64) * np.uint64(4) + np.uint64(salt))
        h = np.zeros(n, np.uint64)
        for j in range(window):
            h = mix(h + word[j : j + n])
        prints.append(h[at])
    order = np.lexsort(prints)
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(order), bool)
    new[1:] = (prints[0][order][1:] != prints[0][order][:-1]) | (prints[1][order][1:] != prints[1][order][:-1])
    first, of = np.flatnonzero(new), passage[at[order]]
    least, most = np.minimum.reduceat(low[of], first), np.maximum.reduceat(high[of], first)
    shared = least < most
    return at[order][first[shared]], least[shared]


def _automaton(window: int):
    """For a shard of passages: confirm the windows that recur, compile these, stream every passage through the machine.

    What is compiled is one place of each recurring window; where it stands in all the
    passages is found by the machine alone.
    """

    def located(group: pa.Table) -> pa.Table:
        phrases = group.column("phrase").combine_chunks()
        split = pa.compute.split_pattern(phrases.cast(pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        ids = words.indices.to_numpy().astype(np.int64)
        size = pa.compute.list_value_length(split).to_numpy().astype(np.int64)
        first = np.concatenate(([0], np.cumsum(size)))
        low, high = group.column("least").to_numpy(), group.column("most").to_numpy()
        at, owner = _confirmed(ids, np.repeat(np.arange(len(size)), size), window, low, high)
        codes, wide = _letters(ids, len(words.dictionary))
        text = lambda a, b: codes[a * wide : b * wide].tobytes().decode("utf-32-le")
        machine = ahocorasick.Automaton()
        for a, o in zip(at.tolist(), owner.tolist(), strict=True):
            machine.add_word(text(a, a + window), o)
        machine.make_automaton()
        keep, owners = [], []
        for k in range(len(size) if len(machine) else 0):
            own = [NONE] * (int(size[k]) - window + 1)
            hit = False
            for end, o in machine.iter(text(first[k], first[k + 1])):
                if (end + 1) % wide == 0:  # not from the middle of a word
                    own[(end + 1) // wide - window] = o
                    hit = True
            if hit:
                keep.append(k)
                owners.append(own)
        part = group.select(["anchor", "print"]).take(pa.array(keep, pa.int64()))
        return part.append_column("owners", pa.array(owners, pa.list_(pa.int64())))

    return located


def _windows(window: int):
    """The windows of passages one by one, with their places and words."""

    def made(batches):
        for whole in batches:
            for batch in pieces(whole, "phrase"):
                for row in batch.to_pylist():
                    words = row["phrase"].split(" ")
                    for a in range(0, len(words) - window + 1, 20_000):
                        k = list(range(a, min(a + 20_000, len(words) - window + 1)))
                        same = [pa.array([row[c]] * len(k), pa.int64()) for c in ("anchor", "print", "least", "most")]
                        yield pa.RecordBatch.from_arrays([
                            *same, pa.array(k, pa.int32()), pa.array([" ".join(words[x : x + window]) for x in k]),
                        ], ["anchor", "print", "least", "most", "k", "words"])

    return made


def _grouped(phrases: DataFrame, window: int) -> DataFrame:
    """What the automata give, for passages of any number: windows are grouped by their words and brought back."""
    windows = phrases.select("anchor", "print", "least", "most", "phrase").mapInArrow(_windows(window), "anchor long, print long, least long, most long, k int, words string")
    owner = windows.groupBy("words").agg(F.min("least").alias("owner"), F.max("most").alias("_most")).where("owner < _most").select("words", "owner")
    back = windows.select("anchor", "print", "k", "words").join(owner, "words", "left")
    back = back.groupBy("anchor", "print").agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("owner", F.lit(NONE)).alias("owner")))).alias("o"), F.count("owner").alias("_n"))
    return back.where("_n > 0").select("anchor", "print", F.col("o.owner").alias("owners"))


def _owners(passages: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(anchor, print, owners) of the passages with windows of several documents: the smallest document of each window, or NONE."""
    hot = passages.select("anchor", "print").distinct().groupBy("anchor").count().where(F.col("count") > HOT)
    hot = scratch.save(hot.select("anchor"))  # a table of its own, so that the joins can split an anchor with many passages
    some = hot.limit(1).count() > 0

    def phrases(of: DataFrame) -> DataFrame:
        return of.groupBy("anchor", "print").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("phrase").alias("phrase"))

    shards = max(1, passages.count() // SHARD_SEGMENTS)
    rest = passages.join(hot, "anchor", "left_anti") if some else passages
    rest = phrases(rest).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    owners = rest.groupBy("shard").applyInArrow(_automaton(window), "anchor long, print long, owners array<long>")
    if some:
        owners = owners.unionByName(_grouped(phrases(passages.join(hot, "anchor", "left_semi")), window))
    return owners


def _removed(window: int):
    def made(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                words = Words(batch.column("text"), hashes=False)
                starts = batch.column("starts")
                whole_copy = np.asarray(pa.compute.fill_null(batch.column("copied"), False))
                count = np.diff(words.first)
                n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(starts), 0))
                step = np.zeros(len(words.start) + 1, np.int64)
                place = np.repeat(words.first[:-1], n) + np.asarray(starts.flatten(), dtype=np.int64)
                np.add.at(step, place, 1)
                np.add.at(step, place + window, -1)
                full = np.flatnonzero(whole_copy & (count >= window))
                np.add.at(step, words.first[full], 1)
                np.add.at(step, words.first[full + 1], -1)
                gone = np.cumsum(step)[:-1] > 0
                data, begin, end = _spaced(words)
                kept, digest, lost = [], [], np.zeros(batch.num_rows, np.int64)
                for r in range(batch.num_rows):
                    a, b = words.first[r], words.first[r + 1]
                    if gone[a:b].any():
                        lost[r] = gone[a:b].sum()
                        stay = np.flatnonzero(~gone[a:b]) + a
                        edge = np.flatnonzero(np.diff(stay) > 1) + 1
                        text = b" ".join(data[begin[x[0]] : end[x[-1]]].tobytes() for x in np.split(stay, edge)) if len(stay) else b""
                    else:
                        text = data[begin[a] : end[b - 1]].tobytes() if b > a else b""
                    kept.append(text.decode())
                    digest.append(hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(lost), pa.array(digest),
                    pa.array(kept),
                ], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return made


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of every row.

    A word goes if a window of ``window`` words that covers it also starts in a
    document with a smaller doc_id.

    1. Of equal texts the one with the smallest doc_id is looked at; the others lose
       all their words if these make a window. Each window is filed under its anchor,
       its least run of ``anchor`` words; anchors that stand in several texts mark the
       passages that may recur.
    2. The passages of one anchor meet in one shard; equal passages are one, with the
       least and greatest of their documents. There windows that stand in several
       documents are confirmed word by word and compiled to an Aho-Corasick automaton
       over words, and every passage is streamed through it, so that each occurrence
       gets the smallest document of its window. Of an anchor with more than 1,000
       different passages the windows are grouped by their words instead, so that no
       task holds them all.
    3. Occurrences are brought back to their documents, and covered words removed.

    Null and empty texts: no words, the digest of nothing. Null doc_id: nothing is
    removed and nothing elsewhere because of it. Rows with one doc_id, also repeated rows,
    don't remove each other's words, so ties between documents can't be. Texts of any
    length are read whole. An empty table gives an empty result. Other columns are left
    out.
    """
    scratch = Scratch(docs.sparkSession)
    text = [F.xxhash64("text").alias("tid"), F.crc32(F.encode("text", "UTF-8")).alias("crc")]
    docs = docs.select(F.col("doc_id").cast("long"), "text", *text)
    able = docs.where("doc_id is not null and text is not null")
    firsts = scratch.save(able.groupBy("tid", "crc").agg(F.min("doc_id").alias("first_id")))
    filed = able.mapInArrow(_anchor_rows(window, anchor), "anchor long, tid long")
    shared = filed.groupBy("anchor").agg(F.min("tid").alias("_lo"), F.max("tid").alias("_hi")).where("_lo < _hi").select("anchor")
    flags = filed.join(shared, "anchor").groupBy("tid").agg(F.collect_set("anchor").alias("anchors"))
    flags = scratch.save(flags.join(firsts, "tid").select("tid", "crc", "first_id", "anchors"))
    del filed, shared
    passages = able.join(flags, ["tid", "crc"]).where("doc_id = first_id").mapInArrow(_segments(window, anchor), "anchor long, doc_id long, pos int, phrase string, tid long, crc long")
    passages = passages.withColumn("print", F.xxhash64("phrase"))
    passages = scratch.save(passages)
    owners = _owners(passages, window, scratch)
    hits = passages.select("anchor", "print", "doc_id", "pos", "tid", "crc").join(owners, ["anchor", "print"])
    starts = F.filter(F.transform("owners", lambda x, k: F.when(x < F.col("doc_id"), F.col("pos") + k)), lambda x: x.isNotNull())
    hits = hits.select("tid", "crc", starts.alias("s")).where(F.size("s") > 0)
    cover = scratch.save(hits.groupBy("tid", "crc").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("starts")))
    scratch.drop(passages)
    del owners, hits, passages
    scratch.done(firsts, cover)
    known = firsts.join(cover, ["tid", "crc"], "left")
    out = docs.join(known, ["tid", "crc"], "left")
    out = out.select(
        "doc_id", "text", F.when(F.col("doc_id") == F.col("first_id"), F.col("starts")).alias("starts"),
        (F.col("doc_id") > F.col("first_id")).alias("copied"),
    )
    return out.mapInArrow(_removed(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op3_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
