"""Embedding near-duplicates by a pivot-permutation index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, table
from strandloom.llm.components import components

THRESHOLD = 0.9
#: Reference points: a sample of the vectors, chosen by hash, of about rows / 50 within these limits. Documented bound.
FEWEST_PIVOTS, MOST_PIVOTS, ROWS_A_PIVOT = 64, 1024, 50
#: Nearest reference points that describe a vector; vectors are compared if they share SHARED of them.
PREFIX, SHARED = 8, 2
#: A longer inverted list is cut into blocks, and each pair of blocks is a unit of work.
BLOCK = 2048
#: Rows of a unit of work that gathers lists, at most about so many.
TASK_ROWS = 20_000


def _random_points(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((FEWEST_PIVOTS, dim))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _permutations(points: dict[int, np.ndarray], prefix: int):
    """For each vector its nearest reference points, nearest first, and the inverted lists it stands in: one per pair of them."""

    def described(batches):
        for batch in batches:
            sizes = np.asarray(pa.compute.list_value_length(batch.column("v")))
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                ref = points.get(int(dim))
                ref = _unit(_random_points(int(dim)) if ref is None or len(ref) < FEWEST_PIVOTS // 4 else ref)
                near = _unit(_matrix(part.column("v"))) @ ref.T
                order = np.argsort(-near, axis=1, kind="stable")[:, :prefix].astype(np.int64)
                a, b = np.triu_indices(order.shape[1], 1)
                pair = (np.minimum(order[:, a], order[:, b]) << 20) | np.maximum(order[:, a], order[:, b])
                lists = (int(dim) << 40) | pair
                n = part.num_rows
                arrays = [part.column("rep")] + [pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * x.shape[1], x.ravel()) for x in (order, lists)]
                yield pa.RecordBatch.from_arrays(arrays, ["rep", "near", "lists"])

    return described


def _first_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest pair of reference points that two descriptions share, as a list number without the dimension."""
    none = np.int64(1 << 19)
    shared = np.sort(np.where((x[:, :, None] == y[:, None, :]).any(axis=2), x, none), axis=1)
    return (shared[:, 0] << 20) | shared[:, 1]


def _verify(threshold: float):
    def verified(batches):
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        table = table.combine_chunks()
        rep, m = table.column("rep").to_numpy(), table.column("m").to_numpy()
        lst, i, j, mine = (table.column(c).to_numpy() for c in ("list", "i", "j", "mine"))
        order = np.lexsort((rep, j, i, lst))
        unit = np.stack([lst, i, j], 1)[order]
        out_a, out_b = [], []
        edge = np.concatenate(([0], np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1, [len(unit)]))
        vectors, nears = table.column("v").combine_chunks(), table.column("near").combine_chunks()
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if hi - lo < 2:
                continue
            at = order[lo:hi]
            x = _unit(_matrix(vectors.take(pa.array(at))))
            if i[at[0]] == j[at[0]]:
                p, q = np.nonzero(np.triu(x @ x.T >= threshold, 1))
            else:
                left, right = np.flatnonzero(mine[at] == i[at[0]]), np.flatnonzero(mine[at] == j[at[0]])
                p, q = np.nonzero(x[left] @ x[right].T >= threshold)
                p, q = left[p], right[q]
            if len(p):
                near = _matrix(nears.take(pa.array(at))).astype(np.int64)
                for k in range(0, len(p), 1 << 18):
                    own = _first_shared(near[p[k : k + (1 << 18)]], near[q[k : k + (1 << 18)]]) == (lst[at[0]] & ((1 << 40) - 1))
                    out_a.append(at[p[k : k + (1 << 18)][own]])
                    out_b.append(at[q[k : k + (1 << 18)][own]])
        if not out_a:
            return
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        # per vector: how many it links with here, and the least vector of its part of the links here
        links = np.bincount(a, m[b], len(rep)) + np.bincount(b, m[a], len(rep))
        root = rep.copy()
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            if (new == root).all():
                break
            root = new
        touched = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(rep[touched]), pa.array(links[touched].astype(np.int64)), pa.array(root[touched])], ["rep", "links", "root"])

    return verified


def link(vectors: DataFrame, threshold: float = THRESHOLD, prefix: int = PREFIX) -> DataFrame:
    """(vec_id, n_links, component_id, kept, n_copies) of every vector.

    Equal vectors are one vector with a count, so copies never become pairs. Each
    vector is described by its ordered nearest reference points. It stands in an
    inverted list for each pair of them, so two vectors meet in a list if they share
    at least two reference points; where they share more, the list of the smallest
    shared pair alone counts them. The cosine, in double precision, decides. Lists
    of any length are compared whole, in pairs of blocks. The index is approximate:
    a linked pair that shares fewer than two reference points is missed (recall is
    measured in the tests). No pair below the threshold is linked. The reference points
    are a sample by hash of the vectors of each length; a length with fewer than 16 sampled
    vectors gets random points instead, which differ in recall alone.

    Null, empty and zero vectors and vectors with null or non-finite components
    link with nothing, not even with their copies: n_links 0, component_id their
    own vec_id, kept. Vectors of different lengths never link. Rows with a null
    vec_id link with nothing and have a null component_id. Repeated rows count as
    copies; rows with one vec_id and different vectors are looked at each by itself.
    Vectors are told apart by a digest of 64 bits. An empty table gives an empty result. Other columns are left out.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("v"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", odd) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(17), "v"))
    narrow = rows.select("vec_id", "good", "k1", "k2")
    reps = rows.where("good").groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("m"), F.first("v").alias("v"))
    first = scratch.save(reps.select(F.col("k1").alias("rep"), "k2", "vec_id", "m", "v"))
    n = first.count()
    want = min(MOST_PIVOTS, max(FEWEST_PIVOTS, n // ROWS_A_PIVOT))
    share = int(1_000_000 * min(1.0, want / max(n, 1)))
    sample = first.where(F.pmod(F.xxhash64("v", F.lit(5)), F.lit(1_000_000)) < share).select("v", F.xxhash64("v", F.lit(6)).alias("o"), "rep")
    sample = sample.orderBy("o", "rep").limit(2 * MOST_PIVOTS).select("v").toArrow().column("v").to_pylist()
    by_dim: dict[int, list] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    points = {dim: np.array(v, dtype=np.float64)[:MOST_PIVOTS] for dim, v in by_dim.items()}
    index = scratch.save(first.select("rep", "v").mapInArrow(_permutations(points, prefix), "rep long, near array<long>, lists array<long>"))
    postings = index.select("rep", F.explode("lists").alias("list"))
    length = postings.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    posted = postings.join(length, "list").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    posted = posted.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    posted = posted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    posted = posted.select("rep", "list", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine")
    posted = scratch.save(posted)
    units = max(1, posted.count() // TASK_ROWS)
    full = posted.join(first.select("rep", "m", "v"), "rep").join(index.select("rep", "near"), "rep")
    full = full.withColumn("unit", F.pmod(F.xxhash64("list", "i", "j"), F.lit(units)))
    verify = _verify(threshold)
    found = full.groupBy("unit").applyInArrow(_grouped(verify), "rep long, links long, root long")
    found = scratch.save(found)
    group = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    done = first.select("rep", "k2", "vec_id", "m").join(links, "rep", "left").join(group, first["rep"] == group["node"], "left")
    done = done.select("rep", "k2", "vec_id", "m", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component_id", "rep").alias("_root"))
    done = scratch.save(done)
    least = done.groupBy("_root").agg(F.min("vec_id").alias("component_id"))
    done = scratch.save(done.join(least, "_root").select(F.col("rep").alias("k1"), "k2", "m", "links", "component_id", F.lit(True).alias("good")))
    scratch.done(done)
    out = narrow.join(done, ["k1", "k2", "good"], "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = out.select(
        "vec_id",
        F.when(F.col("good"), F.col("links") + F.col("m") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce("m", F.lit(1)).cast("long").alias("n_copies"),
    )
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"), "n_copies")


def _grouped(verify):
    def work(group: pa.Table) -> pa.Table:
        out = list(verify(group.to_batches()))
        empty = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        return pa.Table.from_batches(out) if out else empty.empty_table()

    return work


def op1_embedding_near_dedup(spark, sf_dir):
    return link(table(spark, sf_dir, "embeddings"))
