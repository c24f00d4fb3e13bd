"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, fresh, table, word_count

#: Sources by code point get these weights in turn; a target stops at CAP times its source.
WEIGHTS = (1, 2, 3)
CAP = 3
#: Rows of a cell of the prefix sum, at most about so many.
CELL_ROWS = 50_000


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight of the whole, none above cap times its source.

    With sources in the order of cap * size / weight, the level at which the
    uncapped ones end is the greatest quotient of what is left by the weights left.
    The table has one row per source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight)
    order = Window.orderBy(F.lit(float(cap)) * F.col("source_size") / F.col("weight"), "rank")
    before = F.coalesce(F.sum(F.col("source_size") * cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = F.sum("source_size").over(Window.partitionBy())
    ranked = ranked.withColumn("level", (whole - before).cast("double") / after)
    level = F.max("level").over(Window.partitionBy())
    target = F.least((F.col("source_size") * cap).cast("double"), level * F.col("weight"))
    return ranked.select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def _number(text) -> F.Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def systematic_mix(
    docs: DataFrame, seed: str = "mix", weights=WEIGHTS, cap: int = CAP, cells: int | None = None, size: str | None = None, names=("size", "source_size", "target", "copies")
) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target and copies (under ``names``).

    Each document of a source expects target / source_size copies. Along the
    source (by size class, then cell, size and id, so that sizes are spread
    evenly) the expected copies are summed, one offset per source is added, and a
    document is taken once for each integer that the sum crosses in it. The sum is
    in two levels, counts of cells and ranks in a cell, so that a source of any
    size is summed by many tasks. The words taken from a source differ from its target
    by less than its largest document.

    ``size`` names a column with the words of each row; else words of the whole text are
    counted. Null text: size 0. Null source: a source of its own, last in order. Rows
    of equal size go by a digest of the id, then by the id; repeated rows are taken one by
    one. A source of size 0 has target 0 and no copies. Texts of any length count whole.
    An empty table gives an empty result. Columns with the new ones' names are
    replaced, others are kept, whatever their names.
    """
    new = {x.lower() for x in names}
    words = F.col(size).cast("long") if size else word_count(F.col("text"))
    keep = [c for c in docs.columns if c.lower() not in new or c == size]
    w, cls, cell, tie, rank, src, c2, b2, before, count, sums, goal_, have = fresh(
        [*docs.columns, *names], "_w", "_class", "_cell", "_tie", "_rank", "_s", "_c", "_b", "_before", "_n", "_sum", "_target", "_have"
    )
    n = docs.count()
    cells = cells or max(16, n // CELL_ROWS)
    sized = docs.select(*keep, words.alias(w))
    bits, key = F.bin(w), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sized = sized.withColumn(cls, F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.rpad(F.substring(bits, 1, 4), 4, "0")))
    sized = sized.withColumn(tie, F.md5(key)).withColumn(cell, _number(key) % cells)
    counts = sized.groupBy(F.col("source").alias(src), F.col(cls).alias(c2), F.col(cell).alias(b2)).agg(F.count("*").alias(count), F.sum(w).alias(sums))
    order = Window.partitionBy(src).orderBy(c2, b2).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(count).over(order), F.lit(0)))
    goal = targets(counts.groupBy(F.col(src).alias("source")).agg(F.sum(sums).alias("source_size")), weights, cap)
    goal = goal.select(F.col("source").alias(rank), F.col("source_size").alias(have), F.col("target").alias(goal_))
    counts = counts.join(goal, counts[src].eqNullSafe(goal[rank])).select(src, c2, b2, before, have, goal_)
    placed = sized.join(counts, sized["source"].eqNullSafe(counts[src]) & (sized[cls] == counts[c2]) & (sized[cell] == counts[b2]))
    place = F.row_number().over(Window.partitionBy("source", cls, cell).orderBy(w, tie, "doc_id"))
    each = F.when(F.col(have) > 0, F.col(goal_) / F.col(have)).otherwise(F.lit(0.0))
    start = _number(F.concat(F.lit(seed + ":"), F.coalesce(F.col("source"), F.lit("\u0000")))) / F.lit(4294967296.0)
    placed = placed.withColumn(rank, F.col(before) + place)
    crossed = F.floor(each * F.col(rank) + start) - F.floor(each * (F.col(rank) - 1) + start)
    copies = F.least(crossed, F.lit(cap)).cast("long")
    made = [F.col(w).alias(names[0]), F.col(have).alias(names[1]), F.col(goal_).alias(names[2]), copies.alias(names[3])]
    return placed.select(*[c for c in keep if c.lower() not in new], *made)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it is taken.

    Nulls, empty and long texts, ties, repeated rows, empty tables and names of columns
    are treated as by ``systematic_mix``; rows with no words are never taken in a source
    without words.
    """
    *names, copy = fresh(docs.columns, "_size", "_source_size", "_goal", "_copies", "_copy")
    taken = systematic_mix(docs, names=names, **options).where(F.col(names[3]) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(names[3])))).select(*docs.columns)


def op10_source_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    docs = Scratch(spark).save(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")))  # texts are read once
    out = systematic_mix(docs, size="words")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


OP10_SQL = r"""
with base as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
sized as (
  select *, lpad(length(bin(size))::varchar, 2, '0') || rpad(substr(bin(size), 1, 4), 4, '0') as class,
    md5(coalesce(doc_id::varchar, '')) as tie,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint % greatest(16, (select count(*) from base) // 50000) as cell
  from base),
sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from sized group by source),
weighed as (select *, 1 + rank % 3 as weight from sources),
levels as (
  select *, ((sum(source_size) over ())::bigint - coalesce(sum(source_size * 3) over (order by 3.0::double * source_size / weight, rank rows between unbounded preceding and 1 preceding), 0)::bigint)::double
    / (sum(weight) over (order by 3.0::double * source_size / weight, rank rows between current row and unbounded following))::bigint as level
  from weighed),
goals as (
  select source, source_size, greatest(least((source_size * 3)::double, (max(level) over ()) * weight), 0.0::double) as target from levels),
ranked as (
  select d.doc_id, d.size, d.source, g.source_size, g.target,
    case when g.source_size > 0 then g.target / g.source_size else 0.0::double end as each,
    row_number() over (partition by d.source order by class, cell, d.size, tie, d.doc_id) as pos,
    ('0x' || substr(md5('mix:' || coalesce(d.source, chr(0))), 1, 8))::bigint / 4294967296.0::double as start
  from sized d join goals g on d.source is not distinct from g.source),
taken as (
  select *, least(floor(each * pos + start) - floor(each * (pos - 1) + start), 3)::bigint as copies from ranked)
select doc_id, size, source_size, target, copies * size as taken, source, copies from taken
"""
