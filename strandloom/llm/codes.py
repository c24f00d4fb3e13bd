"""Vector code compression: product codes whose nearest entries a VA-file finds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Cells of a coordinate are numbered with so many bits.
BITS = 4
#: Codebooks that a job carries at a time have so many components at most, or those of one length of vectors.
CODEBOOK = 1 << 20
#: Scaled components beyond this are taken as this: squares of differences stay within 64 bits.
FAR = 1 << 30
#: With components up to this, whole distances stay within 64 bits; beyond, Python's integers are used.
NEAR = 1 << 25
#: Numbers in the tables of the vectors whose bounds are looked up at a time.
BLOCK = 1 << 19
MOST = (1 << 63) - 1


def cut(length: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end; equal ones if the length allows, else as equal as can be."""
    return [(p * length // parts, (p + 1) * length // parts) for p in range(parts)]


class Approximation:
    """A VA-file over the entries of one part's codebook.

    Each coordinate of the entries is cut at quantiles into cells of a few bits. For a
    query, tables of each coordinate's least and greatest squared distance to each
    cell add up to bounds of its distance to every entry; entries whose lower bound is
    above the least upper bound can't be nearest. The others are refined with whole numbers.
    """

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        k, dims = entries.shape
        cells = 1 << bits
        self.lo = np.zeros((dims, cells))
        self.hi = np.zeros((dims, cells))
        self.cell = np.zeros((k, dims), np.int64)
        for d in range(dims):
            x = np.sort(entries[:, d])
            marks = np.unique(x[(np.arange(1, cells) * k) // cells])
            at = np.searchsorted(marks, entries[:, d], side="right")
            self.cell[:, d] = at
            for c in np.unique(at):  # the cell is drawn as tight as its entries
                inside = entries[at == c, d]
                self.lo[d, c], self.hi[d, c] = float(inside.min()), float(inside.max())
        # one row per cell of a coordinate, one column per entry: adding up table rows is a product
        self.member = np.zeros((dims * cells, k))
        self.member[(np.arange(dims) * cells + self.cell).ravel(), np.repeat(np.arange(k), dims)] = 1.0

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of squared distances, queries by entries, from lookup tables."""
        q = queries.astype(np.float64)[:, :, None]
        below, above = self.lo[None] - q, q - self.hi[None]
        least = np.maximum(np.maximum(below, above), 0.0) ** 2
        most = np.maximum(np.abs(below), np.abs(above)) ** 2
        n = len(queries)
        return least.reshape(n, -1) @ self.member, most.reshape(n, -1) @ self.member

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each query; of equally near entries the first."""
        best, distance = np.zeros(len(queries), np.int64), np.zeros(len(queries), queries.dtype)
        step = max(1, BLOCK // max(1, self.lo.size))
        for at in range(0, len(queries), step):
            some = queries[at : at + step]
            lower, upper = self.bounds(some)
            # sums of doubles may be off in the last bits once they pass 2^53
            row, entry = np.nonzero(lower <= upper.min(1, keepdims=True) * (1 + 1e-9) + 1e-9)
            gap = some[row] - self.entries[entry]
            exact = (gap * gap).sum(1)
            order = np.lexsort((entry, exact.astype(np.int64) if exact.dtype != object else _ranks(exact), row))
            first = order[np.searchsorted(row[order], np.arange(len(some)))]
            best[at : at + step], distance[at : at + step] = entry[first], exact[first]
        return best, distance


def _ranks(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1]


class Book:
    """The codebooks of vectors of one length: for each part entries by components, in whole numbers."""

    def __init__(self, first: np.ndarray):
        self.length = first.shape[1]
        self.spans = cut(self.length)
        self.entries = [first[:, a:b].copy() for a, b in self.spans]

    def prepared(self):
        if not hasattr(self, "files"):
            self.files = [Approximation(e) for e in self.entries]
        return self

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part of each row."""
        wide = max([abs(rows).max(initial=0), *(abs(e).max(initial=0) for e in self.entries)]) > NEAR
        entry, distance = np.zeros((len(rows), PARTS), np.int64), np.zeros((len(rows), PARTS), object if wide else np.int64)
        for p, ((a, b), file) in enumerate(zip(self.spans, self.prepared().files, strict=True)):
            if b > a:
                part = rows[:, a:b]
                entry[:, p], distance[:, p] = file.nearest(part.astype(object) if wide else part)
        return entry, distance

    def replaced(self, totals: dict[tuple[int, int, int], tuple[int, int]]) -> Book:
        """Each entry becomes the floor of the mean of its parts; entries without parts stay."""
        out = Book.__new__(Book)
        out.length, out.spans, out.entries = self.length, self.spans, [e.copy() for e in self.entries]
        for (p, e, k), (total, count) in totals.items():
            out.entries[p][e, k] = total // count
        return out

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for e in self.entries for x in e.ravel()).encode()).hexdigest()


def _whole(batch_column) -> np.ndarray:
    """Rows of a list column of one length, as a matrix."""
    flat = batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(batch_column), -1) if len(batch_column) else flat.reshape(0, 0)


def _by_length(batch: pa.RecordBatch, books: dict[int, Book]):
    """Rows of a batch whose length has a book here: (positions, matrix, book)."""
    length = np.asarray(batch.column("length"))
    for n in np.unique(length).tolist():
        if n in books:
            at = np.flatnonzero(length == n)
            yield at, _whole(batch.column("v").take(pa.array(at))), books[n]


def _sums(books: dict[int, Book]):
    """Each task adds up the parts of every entry and gives one row for each component of an entry that it used."""

    def work(batches):
        total = {n: [np.zeros(e.shape, object) for e in b.entries] for n, b in books.items()}
        count = {n: np.zeros((PARTS, len(b.entries[0])), np.int64) for n, b in books.items()}
        for batch in batches:
            for _, rows, book in _by_length(batch, books):
                entry, _ = book.assign(rows)
                for p, (a, b) in enumerate(book.spans):
                    used, place = np.unique(entry[:, p], return_inverse=True)
                    # rows of a batch are few enough for sums of 64 bits
                    sums = np.zeros((len(used), b - a), np.int64)
                    np.add.at(sums, place, rows[:, a:b])
                    total[book.length][p][used] += sums
                    count[book.length][p] += np.bincount(entry[:, p], minlength=count[book.length].shape[1])
        for n, book in books.items():
            for p, (a, b) in enumerate(book.spans):
                used = np.flatnonzero(count[n][p])
                if len(used) and b > a:
                    size = len(used) * (b - a)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(size, n, np.int32)), pa.array(np.full(size, p, np.int32)), pa.array(np.repeat(used, b - a).astype(np.int32)),
                        pa.array(np.tile(np.arange(b - a), len(used)).astype(np.int32)), pa.array([str(x) for x in total[n][p][used].ravel()]),
                        pa.array(np.repeat(count[n][p][used], b - a)),
                    ], ["length", "part", "entry", "place", "total", "count"])

    return work


def _codes(books: dict[int, Book], digests: dict[int, str]):
    def work(batches):
        for batch in batches:
            for at, rows, book in _by_length(batch, books):
                entry, distance = book.assign(rows)
                code = [bytes(x).hex() for x in entry.astype(np.uint8)]
                error = [min(int(x), MOST) for x in distance.sum(1)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(at)), batch.column("label").take(pa.array(at)), pa.array(code, pa.string()),
                    pa.array(error, pa.int64()), pa.array([digests[book.length]] * len(at), pa.string()),
                ], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    return work


def _trained(rows: DataFrame, lengths: list[int]) -> dict[int, Book]:
    books = {}
    for n in lengths:
        own = rows.where(F.col("length") == n).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v")
        first = [r["v"] for r in own.collect()]
        books[n] = Book(np.array(first, np.int64).reshape(len(first), n))
    schema = "length int, part int, entry int, place int, total string, count long"
    for _ in range(ROUNDS):
        sums = rows.mapInArrow(_sums(books), schema).groupBy("length", "part", "entry", "place").agg(
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("count").alias("count"),
        )
        totals: dict = {n: {} for n in books}
        for r in sums.collect():  # ENTRIES rows for each component of a length
            totals[r["length"]][r["part"], r["entry"], r["place"]] = (int(r["total"]), r["count"])
        books = {n: book.replaced(totals[n]) for n, book in books.items()}
    return books


def _groups(lengths: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for n in lengths:
        if out and (sum(out[-1]) + n) * ENTRIES <= CODEBOOK and len(out[-1]) < 64:
            out[-1].append(n)
        else:
            out.append([n])
    return out


def compress(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row of ``vectors``.

    Components become floor(1024 * x), vectors are cut in 4 parts, and each part has a
    codebook: at first the parts of the 256 smallest vec_ids, then 4 times the floors of
    the means of the parts nearest to each entry. Nearest entries come from
    ``Approximation``, exact and with ties to the lower index. A round is one job over a
    written table: tasks add up their own rows, so that what is shuffled is at most
    256 sums a component and task, however the vectors are spread over entries. On the
    driver stand only codebooks, 2 KB for each component of a length.

    Vectors that are null or hold null or non-finite components have no row. Fewer than
    256 vectors: as many entries. Vectors of another length have codebooks of their own;
    a length that 4 doesn't divide is cut as equally as can be; an empty vector has code
    00000000 and error 0. Null vec_ids are the last, and rows of one vec_id go by their
    vectors. Null labels are one label. Scaled components beyond 2^30 count as 2^30, and errors beyond
    64 bits as the greatest long. Repeated rows each have a row. An empty table gives
    an empty result. Other columns are left out, whatever their names.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    x = F.col(vector)
    good = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(FAR))), F.lit(-float(FAR)))).cast("long"))
    rows = scratch.save(vectors.where(good).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"), F.size(x).alias("length"), scaled.alias("v"),
    ))
    lengths = sorted(r["length"] for r in rows.select("length").distinct().collect())  # a number for each length of vectors
    schema = rows.select("vec_id", "label").schema.add("code", "string").add("error", "long").add("codebooks_sha256", "string")
    parts = []
    for some in _groups(lengths):
        books = _trained(rows, some)
        coded = rows.where(F.col("length").isin(some)) if len(some) < len(lengths) else rows
        parts.append(scratch.save(coded.mapInArrow(_codes(books, {n: b.digest() for n, b in books.items()}), schema)))
    if not parts:
        parts = [spark.createDataFrame([], schema)]
    codes = parts[0]
    for more in parts[1:]:
        codes = codes.unionByName(more)
    each = codes.groupBy(F.col("label").alias("_label")).agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"),
    )
    out = codes.join(each, codes["label"].eqNullSafe(each["_label"]))
    scratch.drop(rows)
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_vector_codes(spark, sf_dir):
    """Codes of all ``embeddings``; nulls, ties, lengths and repeated rows as in ``compress``."""
    return compress(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Rounds one after the other, each distance worked out in full."""
    def nearest(book: str) -> str:
        return f"""
  select vec_id, p, arg_min(e, (dist, e)) as e, min(dist) as dist from (
    select x.vec_id, x.p, b.e, sum((x.x - b.x) * (x.x - b.x)) as dist from comps x join {book} b on x.p = b.p and x.k = b.k group by x.vec_id, x.p, b.e)
  group by vec_id, p"""

    steps = []
    for r in range(ROUNDS):
        steps.append(f"a{r} as materialized ({nearest(f'b{r}')}),")
        steps.append(f"""m{r} as (
  select x.p, a.e, x.k, floor(sum(x.x)::double / count(*))::bigint as x from comps x join a{r} a on x.vec_id = a.vec_id and x.p = a.p group by x.p, a.e, x.k),
b{r + 1} as materialized (select b.p, b.e, b.k, coalesce(m.x, b.x) as x from b{r} b left join m{r} m on b.p = m.p and b.e = m.e and b.k = m.k),""")
    return f"""
with kept as (
  select vec_id, label, embedding, row_number() over (order by vec_id) - 1 as place from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
comps as materialized (
  select vec_id, place, (i - 1) // (n // {PARTS}) as p, (i - 1) % (n // {PARTS}) as k, floor({SCALE} * c::double)::bigint as x
  from (select vec_id, place, len(embedding) as n, unnest(embedding) as c, generate_subscripts(embedding, 1) as i from kept)),
b0 as materialized (select p, place as e, k, x from comps where place < {ENTRIES}),
{chr(10).join(steps)}
last as materialized ({nearest(f'b{ROUNDS}')}),
coded as (
  select vec_id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' order by p) as code, sum(dist)::bigint as error from last group by vec_id),
book as (select sha256(string_agg(x::varchar, ',' order by p, e, k)) as codebooks_sha256 from b{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from coded join kept using (vec_id), book
"""


OP12_SQL = _sql()
