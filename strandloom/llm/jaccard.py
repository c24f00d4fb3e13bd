"""N-gram Jaccard join in metric space: pivots, regions, triangle windows, recursion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import Scratch, Words, fresh, mix, pieces, table
from strandloom.llm.components import components

GRAM, PERCENT = 4, 85
#: Shingles that are asked first whether another document has them: this many times the share that linked sets may lack...
ASKED = 1.6
#: ...and of a small set so many at least, about.
ASKED_LEAST = 24
#: A region with more points than this, not all of one component, is divided by one more pivot, so many times at most; what
#: is left is joined in either case.
LEAF, LEVELS = 128, 16
#: Parts, by hash of shingle or point, in which shingles of open points are counted and placed: disk holds the shuffle of one.
PARTS = 4
#: Bytes of text that a task works on at a time, which bounds the memory of its arrays.
PIECE = 1 << 19
_U = np.uint64
_EPS = 1e-9


class Sets:
    """The shingle sets of a string column: row and 48-bit shingle, by row and sorted, without repeats."""

    def __init__(self, column: pa.Array, gram: int):
        words = Words(column, lower=True)
        at, h = words.grams(gram)
        row = words.row[at]
        count = np.diff(words.first)
        few = np.flatnonzero((count > 0) & (count < gram))
        extra = []
        for r in few.tolist():
            own = np.uint64(words.first[r + 1] - words.first[r])
            with np.errstate(over="ignore"):
                for x in words.hash[words.first[r] : words.first[r + 1]]:
                    own = own * _U(0x9E3779B97F4A7C15) + x
            extra.append(own)
        row = np.concatenate([row, few]).astype(np.uint64)
        h = np.concatenate([h, mix(np.array(extra, dtype=np.uint64))])
        key = np.sort((row << _U(48)) | (h >> _U(16)))
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        self.row, self.id = (key >> _U(48)).astype(np.int64), key & _U((1 << 48) - 1)
        self.first = np.searchsorted(self.row, np.arange(words.rows + 1))
        self.n = np.diff(self.first)
        self.node = self._sums(mix(self.id + _U(1)))

    def _sums(self, x: np.ndarray) -> np.ndarray:
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
        return mix(total[self.first[1:]] - total[self.first[:-1]] + self.n.astype(np.uint64)).astype(np.int64)

    def packed(self, r: int) -> bytes:
        return self.id[self.first[r] : self.first[r + 1]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _ceiling(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles are asked whose spread hash, as a share of all hashes, is below this; it falls as sets grow."""
    return np.maximum(min(1.0, ASKED * (100 - percent) / 100), np.minimum(1.0, ASKED_LEAST / np.maximum(n, 1)))


class Asked:
    """Which shingles of each set are named (``named``) and which of these decide about the set (``deciding``).

    Every set of a size that linked ones can have names what decides about this one.
    """

    def __init__(self, sets: Sets, percent: int):
        share = mix(sets.id + _U(77)).astype(np.float64) / 2.0**64
        self.named = share < _ceiling(sets.n, percent)[sets.row]
        self.deciding = share < _ceiling(sets.n * 100 // percent + 1, percent)[sets.row]
        self.count = np.bincount(sets.row[self.deciding], minlength=len(sets.n))


def _slim(gram: int, percent: int):
    def made(batches):
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                sets = Sets(batch.column("text"), gram)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array(sets.n), pa.array(sets.node), pa.array(Asked(sets, percent).count),
                ], ["doc_id", "n", "node", "asked"])

    return made


def _named(gram: int, percent: int, deciding: bool):
    """(key, node) of the shingles that are named, or of those that decide."""

    def made(batches):
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                sets = Sets(batch.column("text"), gram)
                asked = Asked(sets, percent)
                use = asked.deciding if deciding else asked.named
                yield pa.RecordBatch.from_arrays([pa.array(sets.id[use].astype(np.int64)), pa.array(sets.node[sets.row[use]])], ["key", "node"])

    return made


def _sets_of(gram: int):
    def made(batches):
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                sets = Sets(batch.column("text"), gram)
                want = np.asarray(batch.column("want"))
                for r in np.flatnonzero(sets.node == want).tolist():
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(want[r])]), pa.array([int(sets.n[r])]), pa.array([sets.packed(r)], pa.binary()),
                    ], ["node", "n", "items"])

    return made


def _batched(made, rows: int = 256):
    def work(batches):
        held = []
        for batch in made(batches):
            held.append(batch)
            if len(held) >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return work


def _distances(batches):
    """Jaccard distance of each pair, and whether it links: intersection against union in whole numbers."""
    for batch in batches:
        shared, union = [], []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = unpack(x.as_py()), unpack(y.as_py())
            both = np.sort(np.concatenate([x, y]))
            k = int((both[1:] == both[:-1]).sum())
            shared.append(k)
            union.append(len(x) + len(y) - k)
        yield pa.RecordBatch.from_arrays([
            batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(union, pa.int64()),
        ], ["a", "b", "shared", "whole"])


def _exploded(part: int, parts: int):
    """(node, key) of the shingles that fall to one part by hash."""

    def made(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                sets = [unpack(x.as_py()) for x in some.column("items")]
                node = np.repeat(np.asarray(some.column("node")), [len(x) for x in sets])
                key = np.concatenate(sets)
                own = key % _U(parts) == part
                yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(key[own].astype(np.int64))], ["node", "key"])

    return made


def _rare_first(items: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(node, key, n, place, weight): the shared shingles among each point's first ones, rarest first, with size, place and how central the point is.

    Counts are taken over all points in ``PARTS`` parts of the shingles, places in
    as many parts of the points; the parts only bound the disk in use at a time.
    """
    counted, out = [], []
    for part in range(PARTS):
        each = items.select("node", "items").mapInArrow(_exploded(part, PARTS), "node long, key long")
        common = scratch.save(each.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"))
        counted.append(scratch.save(each.join(common, "key").select("node", "key", "df")))
        scratch.drop(common)
    own = Window.partitionBy("node")
    place = F.row_number().over(own.orderBy("df", "key")) + F.col("n") - F.count("*").over(own)
    shared = _union(counted)
    for part in range(PARTS):
        each = shared.where(F.pmod("node", F.lit(PARTS)) == part).join(items.select("node", "n"), "node")
        each = each.select("node", "key", "n", place.alias("place"), (F.sum("df").over(own) / F.col("n")).alias("weight"))
        out.append(scratch.save(each.where(F.col("place") <= F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + 1)))
    scratch.drop(*counted)
    return _union(out)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _regions(places: DataFrame) -> DataFrame:
    """(key, pivot): the regions, of those with the same points one, under their first shingle; the pivot is the most central point."""
    of = places.groupBy("key").agg(
        F.bit_xor(F.xxhash64("node")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("_y"),
        F.count("*").alias("_n"), F.max_by("node", F.struct("weight", "node")).alias("pivot"),
    )
    return of.where("_n > 1").groupBy("_x", "_y", "_n").agg(F.min("key").alias("key"), F.min("pivot").alias("pivot")).select("key", "pivot")


def _inner_pairs(last: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that meet in a region, one of them at home there, and can be linked.

    At the first shingle two points share, what follows it bounds their overlap. For the
    smaller point of a linked pair this bound holds against its own size, too, so
    only points whose shingle comes that early meet the others of their region.
    """
    need = F.expr(f"(n * {2 * percent} + {99 + percent}) div {100 + percent}")
    early = last.where(F.col("place") <= F.col("n") - need + 1)
    names = {"member": "a", "l": "la", "d": "da", "n": "na", "place": "pa", "home": "ha"}
    small = lambda rows: rows.select("cell", *[F.col(x).alias(y) for x, y in names.items()])
    can = (F.col("la") != F.col("l")) & (F.col("na") <= F.col("n")) & (F.col("na") * 100 >= F.col("n") * percent) & (F.col("ha") | F.col("home"))
    can &= F.coalesce(F.abs(F.col("da") - F.col("d")) <= (100 - percent) / 100 + _EPS, F.lit(True))
    can &= (F.least(F.col("na") - F.col("pa"), F.col("n") - F.col("place")) + 1) * (100 + percent) >= (F.col("na") + F.col("n")) * percent
    apart, rest = F.col("l") != F.col("main"), F.col("l") == F.col("main")
    pairs = small(early.where(apart)).join(last, "cell").where(can).select("a", "member")
    pairs = pairs.unionByName(small(early.where(rest)).join(last.where(apart), "cell").where(can).select("a", "member"))
    return pairs.select(F.least("a", "member").alias("a"), F.greatest("a", "member").alias("b")).distinct()


def _undone(cells: DataFrame, group: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of regions that hold several components, with each point's component (l) and its pivot's (main)."""
    label = group.select(F.col("node").alias("member"), F.col("component_id").alias("l"))
    main = group.select(F.col("node").alias("pivot"), F.col("component_id").alias("main"))
    rows = cells.join(label, "member", "left").join(main, "pivot", "left")
    rows = scratch.save(rows.withColumns({"l": F.coalesce("l", "member"), "main": F.coalesce("main", "pivot")}))
    out = scratch.save(rows.join(rows.where("l <> main").select("cell").distinct(), "cell", "left_semi"))
    scratch.drop(rows)
    return out


def _divided(rest: DataFrame, leaf: int, percent: int, measured, scratch: Scratch) -> tuple[DataFrame, DataFrame] | None:
    """Large regions as two Voronoi cells each, the others as they are, and the distances that were measured for it.

    The second pivot is the farthest point outside the first one's component. A point's home is
    the cell of its nearer pivot, and it is replicated to the other if that is no farther than
    the threshold's radius twice beyond: of two linked points each reaches the other's home.
    A region within twice the radius of its pivot stays whole, for its pivot would stand in
    both cells, and much else with it.
    """
    far = F.struct((F.col("l") != F.col("main")).cast("int"), F.coalesce("d", F.lit(1.0)), F.xxhash64("member"))
    apart = F.max(F.when(F.col("l") != F.col("main"), F.coalesce("d", F.lit(1.0)))).alias("_apart")
    big = rest.groupBy("cell").agg(F.count("*").alias("_n"), F.max_by("member", far).alias("q"), apart)
    big = big.where((F.col("_n") > leaf) & (F.col("_apart") > 2 * (100 - percent) / 100 + _EPS))
    big = scratch.save(big.select("cell", "q"))
    if not big.limit(1).count():
        return None
    inside = rest.drop("l", "main").join(big, "cell")
    pairs = inside.where("member <> q").select(F.col("member").alias("a"), F.col("q").alias("b"))
    pairs = pairs.unionByName(inside.where("d is null").select(F.col("member").alias("a"), F.col("pivot").alias("b"))).distinct()
    got = measured(pairs)
    to = lambda pivot, name: got.select(F.col("a").alias("member"), F.col("b").alias(pivot), F.col("d").alias(name))
    both = inside.join(to("q", "_dq"), ["member", "q"], "left").join(to("pivot", "_dp"), ["member", "pivot"], "left")
    dp, dq = F.coalesce("d", "_dp"), F.when(F.col("member") == F.col("q"), 0.0).otherwise(F.col("_dq"))
    ways = F.array(F.struct(F.lit(0).alias("k"), F.col("pivot").alias("p"), dp.alias("d")), F.struct(F.lit(1).alias("k"), F.col("q").alias("p"), dq.alias("d")))
    near = F.least(dp, dq)
    both = both.select("cell", "member", "n", "place", "home", near.alias("_near"), F.when(dp <= dq, 0).otherwise(1).alias("_home"), F.explode(ways).alias("w"))
    both = both.where(F.col("w.d") <= F.col("_near") + 2 * (100 - percent) / 100 + _EPS)
    home = F.col("home") & (F.col("w.k") == F.col("_home"))
    both = both.select(
        F.xxhash64("cell", "w.k").alias("cell"), "member", F.col("w.p").alias("pivot"), "n", "place",
        F.col("w.d").alias("d"), home.alias("home"),
    )
    small = rest.join(big, "cell", "left_anti").select(both.columns)
    return scratch.save(small.unionByName(both)), got


def _open(docs: DataFrame, nodes: DataFrame, gram: int, percent: int, scratch: Scratch) -> DataFrame:
    """The points that may be linked: enough of their shingles, of those chosen by hash, stand in another set, too.

    A linked set lacks at most n - ceil(n * percent / 100) of the other's n shingles, so
    no more of those asked may be without a second set.
    """
    named = docs.mapInArrow(_named(gram, percent, False), "key long, node long")
    shared = named.groupBy("key").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).where("_lo <> _hi").select("key")
    shared = scratch.save(shared)
    asked = docs.mapInArrow(_named(gram, percent, True), "key long, node long")
    # each row of documents with this set has named its shingles
    count = scratch.save(asked.join(shared, "key").groupBy("node").agg(F.count("*").alias("found")))
    found = F.coalesce(F.col("found"), F.lit(0)) / F.col("rows")
    enough = F.col("asked") - (F.col("n") - F.expr(f"(n * {percent} + 99) div 100"))
    out = scratch.save(nodes.join(count, "node", "left").where(found >= enough).select("node", "doc_id"))
    scratch.drop(shared, count)
    return out


def join(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``; linked: 100 * intersection >= percent * union.

    The join works on distinct sets; equal sets are one point with many documents.

    1. Far points. Linked points have most shingles in common, so of a choice of shingles
       by hash enough must stand in a second set. A point for which this fails has no
       point, and so no pivot, within the radius; most points end here.
    2. First regions. Pivots alone don't divide this space, in which nearly all distances
       are 1. Shingles are ordered by how few of the open points have them, and a
       point is replicated to the regions of its first shingles, of a length that
       linked points must share one. Regions with the same points are one. A region's
       pivot is its most central point, and distances from points to pivots are exact.
    3. A point within the radius of a pivot is linked with it. A region whose points are
       in one component is done.
    4. Recursion. Other regions with more than ``leaf`` points get a second pivot, and are
       divided in Voronoi cells: a point's home is the cell of its nearest pivot, and the
       window of the triangle inequality replicates it to the cell beyond the border.
       Cells are regions again.
    5. In what is left, points outside the pivot's component are compared with those of
       other components inside the window of the triangle inequality: distances of
       linked points to the pivot differ by at most the radius. The places of the
       shared shingle bound the overlap; pairs below the threshold by this bound don't
       meet. Nothing is left out, so links are exact but for collisions of 48-bit
       shingles in a pair and of 64-bit digests of sets.

    Words are split at white space, A-Z lower-cased. Null and empty texts: no
    shingles, linked with nothing, component_id their own doc_id. Fewer words than
    gram: the whole sequence is one shingle. Null doc_id: n_shingles is given,
    component_id is null, links with nothing. Rows with one doc_id and different texts
    are looked at each by itself. Repeated rows are equal sets. An empty table gives an
    empty result. Other columns are left out.
    """
    return _classes(docs, gram, percent, leaf).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _classes(docs: DataFrame, gram: int, percent: int, leaf: int) -> DataFrame:
    """doc_id, n, node (the digest of the set), top (one of the component's nodes) and component_id of every row, as ``join`` finds them."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    able = docs.where("doc_id is not null")
    slim = scratch.save(docs.mapInArrow(_slim(gram, percent), "doc_id long, n long, node long, asked long"))
    named = slim.where("n > 0 and doc_id is not null")
    nodes = scratch.save(named.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("asked").alias("asked"),
        F.count("*").alias("rows"),
    ))
    open_ = _open(able, nodes, gram, percent, scratch)
    owners = open_.select(F.col("doc_id").alias("_id"), F.col("node").alias("want"))
    texts = able.join(owners, docs["doc_id"] == owners["_id"]).select("want", "text")
    items = scratch.save(texts.mapInArrow(_batched(_sets_of(gram)), "node long, n long, items binary"))
    if items.count() > open_.count():  # rows that are repeated
        items = scratch.save(items.groupBy("node").agg(F.first("n").alias("n"), F.first("items").alias("items")))
    places = _rare_first(items, percent, scratch)
    members = scratch.save(places.join(scratch.save(_regions(places)), "key").select("key", "node", "pivot", "n", "place"))
    size = items.select(F.col("node").alias("pivot"), F.col("n").alias("np"))

    def measured(pairs: DataFrame) -> DataFrame:
        """a, b, d, linked of pairs of nodes."""
        left = items.select(F.col("node").alias("a"), F.col("items").alias("x"))
        right = items.select(F.col("node").alias("b"), F.col("items").alias("y"))
        got = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_distances, "a long, b long, shared long, whole long")
        return scratch.save(got.select(
            "a", "b", (F.lit(1.0) - F.col("shared") / F.col("whole")).alias("d"),
            (F.col("shared") * 100 >= F.col("whole") * percent).alias("linked"),
        ))

    pairs = members.where("node <> pivot").select("node", "n", "pivot").distinct().join(size, "pivot")
    pairs = pairs.where(F.least("n", "np") * 100 >= F.greatest("n", "np") * percent)
    near = measured(pairs.select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    links = near.where("linked").select("a", "b")
    group = components(links, scratch)
    far = near.select(F.col("a").alias("member"), F.col("b").alias("pivot"), "d")  # no row: sizes out of the pivot's window
    d = F.when(F.col("member") == F.col("pivot"), 0.0).otherwise(F.col("d"))
    cells = members.withColumnRenamed("node", "member").join(far, ["member", "pivot"], "left")
    cells = cells.select(F.col("key").alias("cell"), "member", "pivot", "n", "place", d.alias("d"), F.lit(True).alias("home"))
    for level in range(LEVELS + 1):
        rest = _undone(cells, group, scratch)
        parts = _divided(rest, leaf, percent, measured, scratch) if level < LEVELS else None
        if parts is None:
            break
        cells, got = parts
        links = links.unionByName(got.where("linked").select("a", "b"))
        group = components(links, scratch)
    label = group.select(F.col("node").alias("member"), F.col("component_id").alias("l"))
    more = measured(scratch.save(_inner_pairs(rest, percent))).where("linked").select("a", "b")
    # the links of both steps between components, named by their least node
    ends = more.join(label.select(F.col("member").alias("a"), F.col("l").alias("la")), "a", "left").join(
        label.select(F.col("member").alias("b"), F.col("l").alias("lb")), "b", "left",
    )
    joined = components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")), scratch)
    joined = joined.select(F.col("node").alias("l"), F.col("component_id").alias("top"))
    root = nodes.select("node", "doc_id").join(label.withColumnRenamed("member", "node"), "node", "left").select("node", "doc_id", F.coalesce("l", "node").alias("l"))
    root = root.join(joined, "l", "left").select("node", "doc_id", F.coalesce("top", "l").alias("top"))
    least = root.groupBy("top").agg(F.min("doc_id").alias("least"))
    final = scratch.save(root.join(least, "top").select("node", "least", "top"))
    scratch.done(slim, final)
    out = slim.join(final, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n", "node", "top", component.alias("component_id"))


def _with_node(gram: int, text: int):
    """Rows with one more column, the digest of their set."""

    def work(batches):
        for whole in batches:
            for batch in pieces(whole, text, PIECE):
                sets = Sets(batch.column(text), gram)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(sets.n > 0, sets.node, 0)), pa.array(sets.n > 0)], [*batch.schema.names, "_node", "_words"])

    return work


def deduplicated(docs: DataFrame, gram: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each group of linked documents, that with the smallest doc_id, with all its columns.

    Rows without doc_id stay, and so do rows without words, null and empty texts. Of
    rows with the same doc_id and text one stays. Where a doc_id has several texts, each
    is in the group of its own text; of those with a group's smallest doc_id one stays, that with
    the smallest digest. Texts of any length are compared as
    a whole. An empty table gives an empty result. Columns may have any names.
    """
    scratch = Scratch(docs.sparkSession)
    classes = scratch.save(_classes(docs.select("doc_id", "text"), gram, percent, LEAF).where("doc_id is not null"))
    own, one, node, words, first = fresh(docs.columns, "_own", "_one", "_node", "_words", "_first")
    repeated = scratch.save(classes.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(own)))
    kept = classes.where("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    out = docs.where("doc_id is null")
    if not repeated.limit(1).count():
        return docs.join(kept, docs["doc_id"] == kept[own], "left_semi").unionByName(out)
    single = kept.join(repeated, own, "left_anti")
    out = out.unionByName(docs.join(single, docs["doc_id"] == single[own], "left_semi"))
    # only rows whose doc_id stands for several are looked at by their sets
    some = docs.join(repeated, docs["doc_id"] == repeated[own], "left_semi")
    fields = T.StructType([*some.schema.fields, T.StructField(node, T.LongType()), T.StructField(words, T.BooleanType())])
    text = [c.lower() for c in docs.columns].index("text")
    some = some.mapInArrow(_renamed(_with_node(gram, text), fields.names), fields)
    least = classes.where("doc_id = component_id and n > 0").groupBy("top").agg(F.min("doc_id").alias(own), F.min("node").alias(one))
    least = least.select(own, one).distinct()
    some = some.join(least, (some["doc_id"] == least[own]) & (some[node] == least[one]), "left").where(~F.col(words) | F.col(one).isNotNull())
    # without words each different text stays, else one row of the set
    alike = F.when(F.col(words), F.lit("")).otherwise(F.coalesce(F.sha2("text", 256), F.lit("null")))
    some = some.withColumn(first, F.row_number().over(Window.partitionBy("doc_id", words, node, alike).orderBy(F.sha2(F.coalesce("text", F.lit("")), 256))))
    return out.unionByName(some.where(F.col(first) == 1).select(docs.columns))


def _renamed(made, names: list[str]):
    def work(batches):
        for batch in made(batches):
            yield batch.rename_columns(names)

    return work


def op4_ngram_jaccard_join(spark, sf_dir):
    return join(table(spark, sf_dir, "documents"))
