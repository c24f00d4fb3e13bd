"""Sorting, positions, paging, selections of a catalog, per root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.scalars import div_ceil, natural_key
from strandloom.operators.ordering import numbered


def sort_keys(mode: str) -> list[Column]:
    """What each mode sorts by, ascending."""
    keys = {
        "modified": [-F.col("modified_ns")],
        "natural": [natural_key(F.col("file_name"))],
        "size": [-F.col("size")],
        "path": [F.lower("relative_path")],
    }[mode]
    return [*keys, F.col("id")]


def positions(catalog: DataFrame, mode: str = "modified") -> DataFrame:
    """Each row with its position, from 0, among the rows of its root."""
    return numbered(catalog, ["root"], sort_keys(mode), "pos")


def _per_root(rows: DataFrame) -> DataFrame:
    return rows.groupBy("root").agg(F.count("*").alias("_rows"))


def neighbours(placed: DataFrame) -> DataFrame:
    """The rows before and after each, and its label; positions are gapless, so a neighbour is a join away."""
    beside = lambda step, name: placed.select("root", (F.col("pos") + step).alias("pos"), F.col("id").alias(name))
    out = placed.select("root", "id", "pos").join(beside(1, "prev_id"), ["root", "pos"], "left").join(beside(-1, "next_id"), ["root", "pos"], "left")
    label = F.concat((F.col("pos") + 1).cast("string"), F.lit(" / "), F.col("_rows").cast("string"))
    return out.join(_per_root(placed), "root").select("root", "id", "pos", "prev_id", "next_id", label.alias("label"))


def grid(placed: DataFrame, width: int, thumb: int) -> DataFrame:
    cols = max(1, int(width / (thumb + 28)))
    out = placed.join(_per_root(placed), "root")
    return out.select(
        "root", "id", "pos", F.expr(f"pos div {cols}").alias("row"), (F.col("pos") % cols).alias("col"),
        div_ceil(F.col("_rows"), cols).alias("rows"),
    )


def tiers(placed: DataFrame, start: int, end: int) -> DataFrame:
    """Rows on screen, and one screen before and after them."""
    span = end - start
    tier = F.when((F.col("pos") >= start) & (F.col("pos") < end), "visible").when((F.col("pos") >= max(0, start - span)) & (F.col("pos") < end + span), "prefetch")
    return placed.select("root", "id", "pos", tier.alias("tier")).where("tier is not null")


def selected(placed: DataFrame, selection: DataFrame) -> DataFrame:
    return placed.join(selection.select("id"), "id", "left_semi")


def selection_summary(catalog: DataFrame, selection: DataFrame) -> DataFrame:
    """Size of the id set, and bytes of those of its ids that are still there."""
    size = selected(catalog, selection).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))
    return selection.select("id").distinct().agg(F.count("*").alias("n_selected")).join(size)


def toggled(toggles: DataFrame) -> DataFrame:
    return toggles.groupBy("id").agg(F.max_by("checked", "seq").alias("checked")).where("checked").select("id")


def reanchor(placed: DataFrame, anchors: DataFrame) -> DataFrame:
    return anchors.join(placed.select("id", "pos"), "id", "left")


def first_eight(chosen: DataFrame, n: int = 8) -> DataFrame:
    """The first rows of each root, for which a top-n is kept before the shuffle, and how many more there are."""
    ranked = chosen.withColumn("rn", F.row_number().over(Window.partitionBy("root").orderBy("pos"))).where(F.col("rn") <= n)
    more = F.greatest(F.col("_rows") - n, F.lit(0)).cast("long")
    return ranked.join(_per_root(chosen), "root").select("root", F.col("rn").cast("long").alias("rn"), "id", more.alias("more"))


def select_all(catalog: DataFrame) -> DataFrame:
    """Every id of the catalog, once."""
    return catalog.select("id").distinct()


def without_failed(wanted: DataFrame, failed: DataFrame) -> DataFrame:
    """Textures still to be decoded: those whose key hasn't failed in this generation."""
    return wanted.join(failed.select("texture_key"), "texture_key", "left_anti")
