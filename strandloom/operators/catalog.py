"""Snapshot comparison and guarded changes of a catalog."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.ordering import numbered
from strandloom.operators.scratch import saved
from strandloom.schema import FIRST_BATCH, FORMATS, NEXT_BATCH

KEY = ["root", "path"]


def incremental_diff(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """One row per (root, path) with a status; one full outer join.

    reused, updated, inserted, removed; a file that the walk saw but couldn't read (size
    null) is kept as it was cached, or skipped if it wasn't.
    """
    c, p = cur.alias("c"), prev.alias("p")
    on = (F.col("c.root") == F.col("p.root")) & (F.col("c.path") == F.col("p.path"))
    same = (F.col("c.size") == F.col("p.size")) & (F.col("c.modified_ns") == F.col("p.modified_ns")) & (F.col("c.format") == F.col("p.format"))
    known = F.col("p.path").isNotNull()
    status = F.when(F.col("c.path").isNull(), "removed").when(F.col("c.size").isNull(), F.when(known, "kept").otherwise("skipped"))
    status = status.when(~known, "inserted").when(same, "reused").otherwise("updated")
    read = F.col("c.size").isNotNull()
    keep = lambda x: F.when(read, F.col(f"c.{x}")).otherwise(F.col(f"p.{x}")).alias(x)
    either = lambda x: F.coalesce(F.col(f"c.{x}"), F.col(f"p.{x}")).alias(x)
    ids = F.coalesce(F.col("p.id"), F.col("c.id")).alias("id")
    return c.join(p, on, "full_outer").select(
        either("root"), either("path"), ids, *[keep(x) for x in ("size", "modified_ns", "format")],
        status.alias("status"),
    )


def removed_paths(cur: DataFrame, prev: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Cached rows that the walk didn't see; none at all if it met any error."""
    gone = prev.join(cur.select(*KEY), KEY, "left_anti")
    if errors is not None:
        gone = gone.join(errors.agg(F.count("*").alias("_errors"))).where("_errors = 0").drop("_errors")  # one row
    return gone


def scan_stats(diff: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return diff.agg(F.count_if(F.col("status") != "removed").alias("supported"), *[count(s) for s in ("reused", "inserted", "updated", "removed")])


def scan_total(diff: DataFrame, errors: int) -> DataFrame:
    seen = F.count_if(F.col("status") != "removed")
    return diff.agg((seen if errors == 0 else seen + F.count_if(F.col("status") == "removed")).alias("total"))


def batch_assign(diff: DataFrame) -> DataFrame:
    """Flush number of each changed row of a root: one batch of 128, then of 512."""
    changed = numbered(diff.where(F.col("status").isin("inserted", "updated")), ["root"], [F.col("path")], "rn")
    later = 1 + F.floor((F.col("rn") - FIRST_BATCH) / NEXT_BATCH)
    return changed.withColumn("batch", F.when(F.col("rn") < FIRST_BATCH, 0).otherwise(later).cast("long"))


VALUES = ["relative_path", "file_name", "size", "modified_ns", "format", "thumbnail_key"]


def _last(rows: DataFrame, order: str) -> DataFrame:
    """One row for each (root, path), with its values as _new: the greatest by ``order``, of equal ones that with the greatest values."""
    return rows.groupBy(*KEY).agg(F.max(F.struct(F.col(order).alias("_order"), *VALUES)).alias("_new"))


def upsert(catalog: DataFrame, new: DataFrame, order: str = "modified_ns") -> DataFrame:
    """Rows of ``new`` replace those of their (root, path), keep their ids, and lose width and height; others get new ids.

    If ``new`` has several rows of one key, the last by ``order`` counts, and of equal ones
    that with the greatest values, in the order of ``VALUES``; a key has one id and one row in any case.
    Known rows are found by one join, new ones by another, both dealt by the key as the
    choice of the last row is; only new ones are ordered.
    """
    fresh = _last(new, order)
    old = catalog.join(fresh, KEY, "left")
    hit = F.col("_new").isNotNull()
    values = [F.when(hit, F.col(f"_new.{x}")).otherwise(F.col(x)).alias(x) for x in VALUES]
    old = old.select("id", *KEY, *values, *[F.when(~hit, F.col(x)).alias(x) for x in ("width", "height")])
    top = catalog.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    unknown = fresh.join(catalog.select(*KEY), KEY, "left_anti").select(*KEY, *[F.col(f"_new.{x}").alias(x) for x in VALUES])
    added = numbered(unknown, [], [F.col(k) for k in KEY], "_k")
    added = added.join(F.broadcast(top)).select((F.col("_top") + F.col("_k") + 1).alias("id"), *KEY, *VALUES)
    return old.unionByName(added.select("*", *[F.lit(None).cast("int").alias(x) for x in ("width", "height")]))


@contextmanager
def _observed(spark: SparkSession):
    """Plans keep their observations even where nothing flows through them, as when an empty folder is scanned for the first time."""
    rules = {
        "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.PropagateEmptyRelation",
        "spark.sql.adaptive.optimizer.excludedRules": "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation",
    }
    before = {k: spark.conf.get(k, None) for k in rules}
    for k, rule in rules.items():
        spark.conf.set(k, f"{before[k]},{rule}" if before[k] else rule)
    try:
        yield
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)


def scan(catalog: DataFrame, walk: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The catalog after a walk, and what the walk did: a comparison, a merge, a guarded removal, in one pass over both tables.

    ``walk`` has a row for each file seen, of any format, with null size where it
    couldn't be read, and one with ``error`` for each folder that couldn't be listed. Changed files
    are merged in, unreadable ones stay as they were, and cached files that weren't seen
    go only if there is no error. The counts are gathered while the comparison is
    written: visited, supported, reused, inserted, updated, removed, errors, total (supported
    files, and after errors what was kept unseen), and elapsed_ms of that pass.
    Of files that the walk has twice the last by modified_ns counts.
    """
    began = time.monotonic()
    seen, met = Observation(), Observation()
    supported = ~F.col("error") & F.coalesce(F.col("format").isin(*FORMATS), F.lit(False))
    files = walk.observe(
        seen, F.count_if(~F.col("error")).alias("visited"), F.count_if(F.col("error")).alias("errors"), F.count_if(supported).alias("supported"),
    ).where(supported)
    cached = catalog.select(*KEY, F.struct("id", *VALUES, "width", "height").alias("_old"))
    both = _last(files, "modified_ns").join(cached, KEY, "full_outer")
    same = [F.col(f"_new.{x}") == F.col(f"_old.{x}") for x in ("size", "modified_ns", "format")]
    status = F.when(F.col("_new").isNull(), "unseen").when(F.col("_new.size").isNull(), F.when(F.col("_old").isNull(), "skipped").otherwise("kept"))
    status = status.when(F.col("_old").isNull(), "inserted").when(same[0] & same[1] & same[2], "reused").otherwise("updated")
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    both = both.withColumn("status", status).observe(met, *[count(s) for s in ("reused", "inserted", "updated", "unseen")], F.max("_old.id").alias("top"))
    with _observed(catalog.sparkSession):
        merged = saved(both)
    seen, met = seen.get, met.get
    stats = {k: seen[k] for k in ("visited", "supported", "errors")} | {k: met[k] for k in ("reused", "inserted", "updated")}
    stats["removed"] = 0 if stats["errors"] else met["unseen"]
    stats["total"] = stats["supported"] + (met["unseen"] if stats["errors"] else 0)
    stats["elapsed_ms"] = int((time.monotonic() - began) * 1000)
    stay = ["reused", "kept", "updated"] + (["unseen"] if stats["errors"] else [])
    updated = F.col("status") == "updated"
    values = [F.when(updated, F.col(f"_new.{x}")).otherwise(F.col(f"_old.{x}")).alias(x) for x in VALUES]
    old = merged.where(F.col("status").isin(stay)).select(F.col("_old.id").alias("id"), *KEY, *values, *[F.when(~updated, F.col(f"_old.{x}")).alias(x) for x in ("width", "height")])
    added = merged.where("status = 'inserted'").select(*KEY, *[F.col(f"_new.{x}").alias(x) for x in VALUES])
    added = numbered(added, [], [F.col(k) for k in KEY], "_k").select((F.col("_k") + ((met["top"] or 0) + 1)).alias("id"), *KEY, *VALUES)
    return old.unionByName(added.select("*", *[F.lit(None).cast("int").alias(x) for x in ("width", "height")])), stats


def sync(catalog: DataFrame, walk: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """The catalog after a ``scan`` of files without errors, or with those that ``errors`` has a row for."""
    walk = walk.withColumn("error", F.lit(False))
    if errors is not None:
        walk = walk.unionByName(errors.select(F.lit(True).alias("error")), allowMissingColumns=True)
    return scan(catalog, walk)[0]


def update_metadata(catalog: DataFrame, updates: DataFrame) -> DataFrame:
    """Width and height of updates that still fit id, path and modified_ns; of several the last by seq."""
    last = updates.groupBy("id", "path", "modified_ns").agg(F.max_by(F.struct("width", "height"), "seq").alias("u"))
    out = catalog.join(last, ["id", "path", "modified_ns"], "left")
    pick = lambda x: F.when(F.col("u").isNotNull(), F.col(f"u.{x}")).otherwise(F.col(x)).alias(x)
    return out.select(*[pick(c) if c in ("width", "height") else F.col(c) for c in catalog.columns])


def changed_metadata(catalog: DataFrame, results: DataFrame) -> DataFrame:
    """Decode results that say something new about a row that is still the same."""
    r = results.select("path", "id", "modified_ns", F.col("width").alias("new_width"), F.col("height").alias("new_height"))
    both = catalog.join(r, ["path", "id", "modified_ns"]).where("new_width > 0 and new_height > 0")
    return both.where(~(F.col("width").eqNullSafe(F.col("new_width")) & F.col("height").eqNullSafe(F.col("new_height")))).select(
        "id", "path", "modified_ns", F.col("new_width").alias("width"), F.col("new_height").alias("height"),
    )


def migrate(v1: DataFrame) -> DataFrame:
    """Schema 1, one row per path, to schema 2, one per (root, path), with every column; of rows with one new key the one with the greatest id."""
    rest = [c for c in v1.columns if c not in KEY]
    return v1.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "id").alias("_row")).select(*KEY, "_row.*").select(v1.columns)


def key_violations(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def truncate(spark: SparkSession, name: str) -> None:
    """All rows of a catalog's table go, of every root; the table stays."""
    spark.sql(f"TRUNCATE TABLE {name}")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)
