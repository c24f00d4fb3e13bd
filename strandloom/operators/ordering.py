"""Numbers and running sums in an order, from range partitions and their counts, so that no task holds a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.scratch import saved

#: monotonically_increasing_id counts rows of a partition in so many low bits.
BITS = 33


def _laid_out(df: DataFrame, keys: list[Column]) -> DataFrame:
    """``df`` dealt into ranges of the order and written, with the range (_part) and the place in it (_at).

    There are as many ranges as the session has shuffle partitions, or fewer where these
    are small, and Spark chooses their borders from a sample. Written, because
    another evaluation could choose other borders. Rows whose keys are all equal share a range.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    return saved(ranged.select(*df.columns, F.shiftright("_id", BITS).cast("int").alias("_part"), F.col("_id").bitwiseAND((1 << BITS) - 1).alias("_at")))


def _placed(rows: DataFrame, own: DataFrame, group: list[str], bases: dict[str, Column]) -> DataFrame:
    """``rows`` with each of ``bases`` from ``own``, which has a row for each group and range."""
    on = [*group, "_part"]
    each = own.select(*[F.col(c).alias(f"_on{k}") for k, c in enumerate(on)], *[c.alias(name) for name, c in bases.items()])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_on{k}")) for k, c in enumerate(on)])
    return rows.join(each, same).select(*rows.columns, *bases)


def numbered(df: DataFrame, group: list[str], keys: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place, from 0, among the rows of its group in the order of ``keys`` (ascending, nulls first).

    The place in the range, less the group's first one there, plus the group's rows in
    earlier ranges: counts by group and range are all that is summed up.
    """
    rows = _laid_out(df, [F.col(g) for g in group] + keys)
    own = rows.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_lo"))
    above = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    out = _placed(rows, own, group, {"_base": F.coalesce(F.sum("_n").over(above), F.lit(0)) - F.col("_lo")})
    return out.withColumn(name, (F.col("_base") + F.col("_at")).cast("long")).drop("_base", "_part", "_at")


def running_before(df: DataFrame, group: list[str], keys: list[Column], name: str, value: str, place: str | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group that come first in the order of ``keys``, and their number as ``place``."""
    rows = _laid_out(df, [F.col(g) for g in group] + keys)
    own = rows.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_lo"), F.coalesce(F.sum(value), F.lit(0)).alias("_each"))
    above = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda x: F.coalesce(F.sum(x).over(above), F.lit(0))
    inner = Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    out = _placed(rows, own, group, {"_sum": before("_each"), "_base": before("_n") - F.col("_lo")})
    out = out.withColumn(name, (F.col("_sum") + F.col("_own")).cast("long"))
    if place:
        out = out.withColumn(place, (F.col("_base") + F.col("_at")).cast("long"))
    return out.drop("_sum", "_base", "_own", "_part", "_at")
