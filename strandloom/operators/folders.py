"""Directly empty folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.scalars import path_depth, relative_path


def empty_folders(dirs: DataFrame, entries: DataFrame, root: str) -> DataFrame:
    """Readable folders below root without any entry; an empty subfolder is an entry. ``sort_key`` orders them."""
    found = dirs.where((F.col("path") != root) & ~F.col("error")).join(entries.select(F.col("parent").alias("path")), "path", "left_anti")
    relative = relative_path(F.col("path"), F.lit(root))
    return found.select("path", relative.alias("relative_path"), F.lower(relative).alias("sort_key"))


def reverify(candidates: DataFrame, fresh_dirs: DataFrame, fresh_entries: DataFrame, root: str) -> DataFrame:
    return candidates.select("path").join(empty_folders(fresh_dirs, fresh_entries, root), "path")


def stats(dirs: DataFrame, empty: DataFrame) -> DataFrame:
    return dirs.agg(F.count("*").alias("visited"), F.count_if("error").alias("errors")).join(empty.agg(F.count("*").alias("found")))


def depth_order(folders: DataFrame) -> DataFrame:
    """Depth of each folder; deletion goes from the deepest up."""
    return folders.withColumn("depth", path_depth(F.col("path")).cast("long"))
