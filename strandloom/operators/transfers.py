"""File operations as data: conflicts, policies, renames, plans, verification. Nothing is moved or deleted."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.scalars import same_path
from strandloom.operators.ordering import numbered
from strandloom.operators.scratch import saved

MOST_RENAMES = 99_999


def conflicts(selection: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose name, without regard to case, is taken at the destination or by another row."""
    taken = existing.select(F.lower("name").alias("key")).distinct().withColumn("dest_exists", F.lit(True))
    out = selection.withColumn("key", F.lower("file_name"))
    twins = out.groupBy("key").agg(F.count("*").alias("twins"))
    out = out.join(twins, "key").join(taken, "key", "left").withColumn("dest_exists", F.coalesce("dest_exists", F.lit(False)))
    return out.withColumn("conflict", F.col("dest_exists") | (F.col("twins") > 1)).drop("key")


def policies(items: DataFrame, overrides: DataFrame, default: str) -> DataFrame:
    return items.join(overrides.select("path", F.col("policy").alias("_p")), "path", "left").withColumn("policy", F.coalesce("_p", F.lit(default))).drop("_p")


_NUMBERED = r"(?s)^(.+) \(([1-9][0-9]{0,4})\)$"


def _named(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the name in lower case (key), its stem and extension, and, if it is a numbered one, the key and number that it is made from."""
    key = F.lower(name)
    dot = F.length(key) - F.instr(F.reverse(key), ".") + 1
    df = df.withColumn("key", key).withColumn("_dot", F.when((F.instr(key, ".") > 0) & (dot > 1), dot).otherwise(F.length(key) + 1))
    df = df.withColumn("stem", F.expr("substring(key, 1, _dot - 1)")).withColumn("ext", F.expr("substring(key, _dot)")).drop("_dot")
    number = F.regexp_extract("stem", _NUMBERED, 2)
    of = F.when(number != "", F.concat(F.regexp_extract("stem", _NUMBERED, 1), F.col("ext")))
    return df.withColumn("of", of).withColumn("number", F.when(number != "", number.cast("int")))


def _skipped(batches):
    """Of the numbers of a name that items ask for themselves, in order, those that are taken when the count comes to them.

    ``late`` is how many earlier ones must have been taken for the count to come in time.
    """
    for batch in batches:
        keys, numbers, lates = batch.column("of"), batch.column("numbers"), batch.column("lates")
        out_key, out_number = [], []
        for key, number, late in zip(keys, numbers, lates, strict=True):
            taken = 0
            for k, a in zip(number.as_py(), late.as_py(), strict=True):
                if taken < a:
                    taken += 1
                    out_key.append(key.as_py())
                    out_number.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.string()), pa.array(out_number, pa.int32())], ["of", "number"])


def _allotted(jobs: DataFrame, asked: DataFrame, there: DataFrame, most: int) -> DataFrame:
    """``jobs`` (key, x, seq: the x-th that needs a number of this name) with the number that each gets.

    Numbers in the folder are taken from the start. One that an item asks for itself
    (``asked``: of, number, d) is taken when the count comes to it after d, and given out otherwise. The count
    reaches number c, of which r are not in the folder up to it, with job r less the asked ones
    passed over, so c is passed over if fewer than r less the jobs before d were. With what is
    passed over known, the x-th job gets the x-th number of the rest. A name has at most
    ``most`` numbers, which bounds every window here.
    """
    live = jobs.select(F.col("key").alias("of")).distinct()
    taken = there.where(F.col("number") <= most).select("of", "number").distinct().join(live, "of", "left_semi")
    asked = asked.where(F.col("number") <= most).join(taken, ["of", "number"], "left_anti").join(live, "of", "left_semi")
    up = Window.partitionBy("of").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.select("of", "number", "d").unionByName(taken.withColumn("d", F.lit(None).cast("long")))
    rank = both.withColumn("r", F.col("number") - F.sum(F.when(F.col("d").isNull(), 1).otherwise(0)).over(up)).where("d is not null")
    times = rank.select("of", "number", "r", F.col("d").alias("at"), F.lit(0).alias("job"))
    times = times.unionByName(jobs.select(F.col("key").alias("of"), F.lit(None).cast("int").alias("number"), F.lit(None).cast("long").alias("r"), F.col("seq").alias("at"), F.lit(1).alias("job")))
    by_time = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    late = times.withColumn("late", F.col("r") - F.sum("job").over(by_time)).where("job = 0 and late > 0")
    gathered = late.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("number", "late"))).alias("c"))  # at most as many as there are numbers
    passed = gathered.select("of", F.col("c.number").alias("numbers"), F.col("c.late").alias("lates")).mapInArrow(_skipped, "of string, number int")
    blocked = taken.unionByName(passed)
    free = F.col("number") - F.row_number().over(Window.partitionBy("of").orderBy("number"))  # free numbers below it
    line = blocked.select("of", free.cast("long").alias("x"), F.lit(1).alias("blocked"), F.lit(None).cast("long").alias("seq"))
    line = line.unionByName(jobs.select(F.col("key").alias("of"), "x", F.lit(0).alias("blocked"), "seq"))
    before = Window.partitionBy("of").orderBy("x", "blocked").rowsBetween(Window.unboundedPreceding, 0)
    got = line.withColumn("got", F.col("x") + F.sum("blocked").over(before)).where("blocked = 0")
    return got.select(F.col("of").alias("key"), "seq", F.when(F.col("got") <= most, F.col("got")).alias("got"))


def auto_rename(items: DataFrame, existing: DataFrame, most: int = MOST_RENAMES) -> DataFrame:
    """Collision-free targets, as if item after item in order of seq, which no two items share.

    A name is used from the start if it is in the folder, else from the first item that
    asks for it or gets it as a numbered name. Items that ask for a used name later collide; those that may
    be renamed are numbered in order, and the x-th gets the x-th number that is free for it.
    Numbered names that items ask for themselves depend on the names that they are made from,
    so names are worked through by how often they are numbered, a few levels. However
    many items ask for one name, they are counted by range partitions; only the first
    ``most`` of a name can get a number, and the rest are exhausted, which ends the whole request.
    """
    left = _named(items.select(F.col("seq").cast("long").alias("seq"), "file_name", "policy"), "file_name")
    left = left.withColumn("level", F.regexp_count(F.regexp_extract("stem", r"((?: \([1-9][0-9]{0,4}\))+)$", 1), F.lit(r"\(")))
    there = _named(existing.select("name"), "name").select("key", "of", "number")
    first = left.groupBy("key", "of", "number").agg(F.min("seq").alias("d"))
    levels = sorted(r["level"] for r in left.select("level").distinct().collect())  # a name has room for some 60
    given, parts = None, []
    for level in levels:
        rows = left.where(F.col("level") == level).drop("of", "number", "level")
        used = first.select("key", "d").join(there.select("key").distinct().withColumn("there", F.lit(True)), "key", "left")
        if given is None:
            used = used.withColumn("at", F.col("d"))
        else:
            used = used.join(given, "key", "left").withColumn("at", F.least("d", "given"))
        rows = rows.join(used.select("key", "there", "at"), "key").withColumn("collides", F.coalesce("there", F.lit(False)) | (F.col("seq") > F.col("at")))
        rows = saved(rows.drop("there", "at"))
        wants = numbered(rows.where("collides and policy = 'auto_rename'").select("key", "seq"), ["key"], [F.col("seq")], "x")
        jobs = wants.withColumn("x", F.col("x") + 1).where(F.col("x") <= most)
        jobs = saved(jobs) if len(levels) > 1 else jobs
        got = _allotted(jobs, first.where("of is not null").select("of", "number", "d"), there.where("of is not null"), most)
        got = saved(got) if len(levels) > 1 else got
        out = rows.join(got, ["key", "seq"], "left")
        dot = F.length("file_name") - F.length("ext")  # lower case may have another length; then the last dot decides
        own = F.when(F.lower(F.expr("substring(file_name, length(file_name) - length(ext) + 1)")) == F.col("ext"), dot)
        own = F.coalesce(own, F.length("file_name") - F.instr(F.reverse("file_name"), "."))
        out = out.withColumn("_dot", own)
        renamed = F.concat(F.expr("substring(file_name, 1, _dot)"), F.lit(" ("), F.col("got").cast("string"), F.lit(")"), F.expr("substring(file_name, _dot + 1)"))
        target = F.when(~F.col("collides") | (F.col("policy") == "overwrite"), F.col("file_name")).when(F.col("policy") == "auto_rename", renamed)
        exhausted = F.col("collides") & (F.col("policy") == "auto_rename") & F.col("got").isNull()
        parts.append(out.select("seq", "file_name", "policy", target.alias("target"), exhausted.alias("exhausted")))
        names = rows.select("key", "seq", "stem", "ext").join(got.where("got is not null"), ["key", "seq"])
        given = names.select(F.concat("stem", F.lit(" ("), F.col("got").cast("string"), F.lit(")"), "ext").alias("key"), F.col("seq").alias("given"))
    if not parts:
        parts = [left.select("seq", "file_name", "policy", F.col("file_name").alias("target"), F.lit(False).alias("exhausted"))]
    return reduce(DataFrame.unionByName, parts)


def plan(items: DataFrame, existing: DataFrame, destination: str) -> DataFrame:
    """Status of each item before anything happens: missing, same place, no target, no name left, or planned.

    Missing sources are skipped first and reserve no name; deletions need none.
    """
    moves = F.col("action").isin("copy", "move")
    resolved = auto_rename(items.where(F.col("source_exists") & moves), existing).select("seq", "target", "exhausted")
    out = items.join(resolved, "seq", "left")
    target = F.concat(F.lit(destination + "/"), F.col("target"))
    status = F.when(~F.col("source_exists"), "skipped_missing").when(~moves, "planned").when(F.col("exhausted"), "failed_names")
    status = status.when(F.col("target").isNull(), "skipped_conflict")
    status = status.when(same_path(F.col("path"), target) & (F.col("action") == "move"), "skipped_same").otherwise("planned")
    return out.select("seq", "path", "action", target.alias("target_path"), status.alias("status"))


def permanent_delete(items: DataFrame, entries: DataFrame) -> DataFrame:
    """What a permanent deletion of ``items`` (path, is_dir, source_exists) does: files go, folders only without entries (parent), a missing source fails."""
    full = entries.select(F.col("parent").alias("path")).distinct().withColumn("_full", F.lit(True))
    good = F.col("source_exists") & ~(F.col("is_dir") & F.coalesce("_full", F.lit(False)))
    return items.join(full, "path", "left").withColumn("status", F.when(good, "succeeded").otherwise("failed")).drop("_full")


def verify(items: DataFrame, cancelled: bool) -> DataFrame:
    """Result of each item by what is there afterwards."""
    gone, there = ~F.col("source_exists"), F.col("target_exists")
    good = F.when(F.col("action").isin("recycle_delete", "permanent_delete"), gone).when(F.col("action") == "copy", there).otherwise(gone & there)
    return items.withColumn("status", F.when(good, "succeeded").when(F.lit(cancelled), "skipped").otherwise("failed"))


def summary(report: DataFrame) -> DataFrame:
    return report.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("succeeded", "skipped", "failed")])


def apply_report(catalog: DataFrame, report: DataFrame) -> DataFrame:
    """The catalog without what was moved or deleted; copies leave it as it is."""
    gone = report.where((F.col("status") == "succeeded") & (F.col("action") != "copy")).select("path")
    return catalog.join(gone, "path", "left_anti")
