"""Sharding by balanced label propagation, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, table, utf8_bytes

#: Cells of the histograms with which flows are cut to their quotas; these tables stay this small at any input.
CELLS = 256
START_CELLS = 16384
ROUNDS = 5
#: How far from the mean a round of propagation may take a shard's bytes; evening out follows each round.
SLACK = 0.25
SLOT_ROWS = 20_000


def _cell(salt: int, cells: int, *columns) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(cells)).cast("int")


def _start(rows: DataFrame, n: int, total: int) -> DataFrame:
    """Even start without regard to links: hash cells in order, cut into n parts of equal bytes."""
    rows = rows.withColumn("_cell", _cell(0, START_CELLS, "doc_id", "_text"))
    cells = rows.groupBy("_cell").agg(F.sum("size").alias("_s"))
    upto = F.sum("_s").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
    part = F.floor((upto - F.col("_s") / 2) * n / F.lit(max(total, 1)))
    cells = cells.select("_cell", F.least(part, F.lit(n - 1)).cast("int").alias("shard"))
    return rows.join(F.broadcast(cells), "_cell").drop("_cell")  # START_CELLS rows at most


def _loads(rows: DataFrame, n: int) -> DataFrame:
    every = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("shard"))
    have = rows.groupBy("shard").agg(F.sum("size").alias("_load"))
    return every.join(F.broadcast(have), "shard", "left").select("shard", F.coalesce("_load", F.lit(0)).alias("load"))  # n rows


def _round(rows: DataFrame, n: int, total: int, salt: int, scratch: Scratch) -> DataFrame:
    """One step: linked rows ask for the shard where most bytes of their neighbours are; quotas grant a part.

    From i to j as much may move as moves from j to i, and beyond that what the
    slack above and below the mean allows.
    """
    most, least = total / n * (1 + SLACK), total / n * (1 - SLACK)
    votes = rows.where("_linked").groupBy("_text", "shard").agg(F.sum("size").alias("_w"))
    goal = votes.groupBy("_text").agg(F.max_by("shard", F.struct("_w", F.xxhash64("_text", "shard"))).alias("goal"))
    goal = scratch.save(goal)  # a table of its own, so that the join can split a text with many rows
    asked = rows.where("_linked").join(goal, "_text")
    moving = asked.where("shard <> goal").withColumn("_cell", _cell(salt, CELLS, "_text", "doc_id"))
    flow = moving.groupBy("shard", "goal", "_cell").agg(F.sum("size").alias("_s"))
    pair = flow.groupBy("shard", "goal").agg(F.sum("_s").alias("f"))
    back = pair.select(F.col("shard").alias("goal"), F.col("goal").alias("shard"), F.col("f").alias("g"))
    loads = _loads(rows, n)
    pair = pair.join(back, ["shard", "goal"], "left").withColumn("g", F.coalesce("g", F.lit(0)))
    pair = pair.withColumn("even", F.least("f", "g")).withColumn("more", F.col("f") - F.col("even"))
    pair = pair.join(loads, "shard").withColumnRenamed("load", "_from")
    pair = pair.join(loads.select(F.col("shard").alias("goal"), F.col("load").alias("_to")), "goal")
    room = F.greatest(F.lit(most) - F.col("_to"), F.lit(0.0)) * F.col("more") / F.greatest(F.sum("more").over(Window.partitionBy("goal")), F.lit(1))
    spare = F.greatest(F.col("_from") - F.lit(least), F.lit(0.0)) * F.col("more") / F.greatest(F.sum("more").over(Window.partitionBy("shard")), F.lit(1))
    pair = pair.select("shard", "goal", (F.col("even") + F.least(room, spare)).alias("quota"))
    upto = F.sum("_s").over(Window.partitionBy("shard", "goal").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
    granted = flow.withColumn("_upto", upto).join(pair, ["shard", "goal"]).where("_upto <= quota")
    granted = granted.select("shard", "goal", "_cell", F.lit(True).alias("_go"))
    moved = moving.join(F.broadcast(granted), ["shard", "goal", "_cell"], "left")  # n * n * CELLS rows at most
    moved = moved.withColumn("shard", F.when(F.col("_go"), F.col("goal")).otherwise(F.col("shard")))
    stay = asked.where("shard = goal")
    return rows.where("not _linked").unionByName(stay.select(*rows.columns)).unionByName(moved.select(*rows.columns))


def _even_out(rows: DataFrame, n: int, total: int, salt: int, linked: bool = False) -> DataFrame:
    """Rows without links (with ``linked`` also linked ones, after those) move from shards above the mean to those below."""
    mean = total / n
    rows = rows.withColumn("_cell", _cell(salt, 4 * CELLS, "doc_id", "_text"))
    loads = _loads(rows, n).withColumn("over", F.greatest(F.col("load") - F.lit(mean), F.lit(0.0))).withColumn("under", F.greatest(F.lit(mean) - F.col("load"), F.lit(0.0)))
    cells = rows.where(F.lit(linked) | ~F.col("_linked")).groupBy("shard", "_linked", "_cell").agg(F.sum("size").alias("_s"))
    upto = F.sum("_s").over(Window.partitionBy("shard").orderBy("_linked", "_cell").rowsBetween(Window.unboundedPreceding, 0))
    out = cells.withColumn("_upto", upto).join(loads, "shard").where("_upto <= over")
    # what leaves is laid end to end and cut where the gaps of the shards below the mean end
    at = F.sum("_s").over(Window.orderBy("shard", "_linked", "_cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s") / 2
    out = out.select("shard", "_linked", "_cell", at.alias("_at"))
    gap = F.sum("under").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    gaps = loads.where("under > 0").select(F.col("shard").alias("goal"), gap.alias("_hi"), (gap - F.col("under")).alias("_lo"))
    out = out.join(F.broadcast(gaps), (F.col("_at") > F.col("_lo")) & (F.col("_at") <= F.col("_hi")))  # n rows
    out = out.select("shard", "_linked", "_cell", "goal")
    moved = rows.join(F.broadcast(out), ["shard", "_linked", "_cell"], "left")  # 2 * n * 4 * CELLS rows at most
    return moved.withColumn("shard", F.coalesce("goal", "shard")).drop("goal", "_cell")


def number_slots(rows: DataFrame, cells: int) -> DataFrame:
    """Gapless numbers from 0 in each shard, by counts of hash cells and ranks in a cell."""
    rows = rows.withColumn("_cell", _cell(1, cells, "doc_id", "_text"))
    counts = rows.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_cell", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("doc_id", "_text")) - 1
    return rows.join(counts, ["shard", "_cell"]).withColumn("slot", (F.col("_base") + rank).cast("long")).drop("_cell", "_base")


def shard(docs: DataFrame, n: int = 16, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; law ``bytes``: sizes near equal.

    Documents with equal texts are linked, each to all others of its text; the
    links are kept as one node per text, so copies never become pairs. From an
    even start by hash, rounds of balanced label propagation move linked
    documents to the shard that holds most bytes of their text, under quotas.
    A text whose copies are more than a shard holds is split over shards.

    size is the text's bytes in UTF-8 plus 1. Null text: size 1, text_crc32 0, no
    links. An empty text: size 1, text_crc32 0, linked with other empty texts.
    Null doc_id and repeated rows each get a slot. Ties in votes go by a hash of text and
    shard, ties in slots by id and text. A text of any length is one row and stays whole.
    grown_shard is null under this law. An empty table gives an empty result. Other
    columns are left out.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(
        "doc_id", (utf8_bytes(F.col("text")) + 1).alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.unhex(F.md5("text")).alias("_text"),
    )
    rows = scratch.save(rows)
    many = rows.where("_text is not null").groupBy("_text").agg(F.count("*").alias("_n")).where("_n > 1").select("_text", F.lit(True).alias("_linked"))
    many = scratch.save(many)
    sums = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()
    total = int(sums["s"])
    now = rows.join(many, "_text", "left").withColumn("_linked", F.coalesce("_linked", F.lit(False)))
    now = scratch.save(_start(now, n, total))
    for k in range(rounds):
        then = scratch.save(_round(now, n, total, 10 + k, scratch))
        scratch.drop(now)
        now = scratch.save(_even_out(then, n, total, 100 + k))
        scratch.drop(then)
    now = scratch.save(_even_out(now, n, total, 200, linked=True))
    scratch.done(now)
    out = number_slots(now, max(16, int(sums["n"]) // (n * SLOT_ROWS)))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_balanced_sharding(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"))
