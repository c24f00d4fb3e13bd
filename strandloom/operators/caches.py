"""Cache inventory, eviction, and the header of cache files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.scalars import le8
from strandloom.operators.ordering import running_before
from strandloom.schema import CACHE_MAGIC


def inventory(files: DataFrame) -> DataFrame:
    left = F.instr("name", ".tmp-") == 0
    return files.agg(
        F.count_if(~left).alias("leftovers"), F.count_if(left).alias("n_files"),
        F.coalesce(F.sum(F.when(left, F.col("size"))), F.lit(0)).alias("bytes"),
    )


def eviction(files: DataFrame, high: int, low: int) -> DataFrame:
    """Above ``high`` in sum, the oldest files go until ``low`` is reached; unknown times first."""
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    before = running_before(files, [], [F.col("mtime"), F.col("path")], "before", "size")  # nulls are first
    return before.join(total).where((F.col("total") > high) & (F.col("total") - F.col("before") > low)).drop("total", "before")


def lru(textures: DataFrame, budget: int) -> DataFrame:
    """Textures that stay: the latest used whose sum fits the budget."""
    known = F.when(F.col("last_used").isNull(), 1).otherwise(0)
    before = running_before(textures, [], [known, -F.col("last_used"), F.col("path")], "before", "size")
    return before.where(F.col("before") + F.col("size") <= budget).drop("before")


def lru_victim(textures: DataFrame) -> DataFrame:
    return textures.agg(F.min_by("path", F.struct("last_used", "path")).alias("path"))


def encode(entries: DataFrame) -> DataFrame:
    """``content`` of cache files: magic, four dimensions, pixels; null where dimensions and pixels don't fit."""
    four = lambda x: F.substring(le8(F.col(x).cast("long")), 1, 4)
    names = ("source_width", "source_height", "width", "height")
    fits = F.expr("source_width > 0 and source_height > 0 and width > 0 and height > 0") & (F.octet_length("pixels") == 4 * F.col("width") * F.col("height"))
    content = F.concat(F.lit(CACHE_MAGIC.encode()), *[four(x) for x in names], F.col("pixels"))
    return entries.withColumn("content", F.when(F.coalesce(fits, F.lit(False)), content))


def still_fresh(writes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Writes of images that are still as they were when they were decoded."""
    return writes.join(catalog.select("path", "size", "modified_ns"), ["path", "size", "modified_ns"], "left_semi")


def write_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    o = old.select("path", F.col("size").alias("_old"))
    return new.join(o, "path", "left").select("path", (F.col("size") - F.coalesce("_old", F.lit(0))).alias("delta"))


def decode_header(files: DataFrame) -> DataFrame:
    """Source and own dimensions of cache files (column content); null where the file isn't valid."""
    digits = F.hex("content")
    word = lambda at: F.conv(F.concat(*[F.substring(digits, 2 * (at + k) + 1, 2) for k in (3, 2, 1, 0)]), 16, 10).cast("long")
    names = ("source_width", "source_height", "width", "height")
    out = files.select(
        "path", F.octet_length("content").alias("_n"),
        (F.substring(digits, 1, 16) == CACHE_MAGIC.encode().hex().upper()).alias("_magic"),
        *[word(8 + 4 * k).alias(x) for k, x in enumerate(names)],
    )
    valid = F.col("_magic") & (F.col("_n") >= 24) & F.expr("source_width > 0 and source_height > 0 and width > 0 and height > 0") & (F.col("_n") == 24 + 4 * F.col("width") * F.col("height"))
    valid = F.coalesce(valid, F.lit(False))
    return out.select("path", valid.alias("valid"), *[F.when(valid, F.col(x)).alias(x) for x in names])
