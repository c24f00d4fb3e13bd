"""Event streams as batches: generations, latest wins, folds, queues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.ordering import numbered


def current_generation(events: DataFrame) -> DataFrame:
    """Events of the generation that was started last."""
    now = events.where("kind = 'started'").agg(F.max_by("generation", "seq").alias("_now"))
    return events.join(now, events["generation"] == now["_now"]).drop("_now")


def accepted_sorts(results: DataFrame, state: DataFrame) -> DataFrame:
    return results.join(state, ["generation", "revision", "mode"], "left_semi")


def latest(requests: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    rest = [c for c in requests.columns if c != key]
    return requests.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(key, "_r.*")


def apply_upserts(records: DataFrame, events: DataFrame) -> DataFrame:
    """Known paths are replaced in place, others appended in order of seq; the last write of a path wins."""
    last = events.groupBy("root", "path").agg(F.max_by("size", "seq").alias("_size"), F.min("seq").alias("_first"))
    top = records.groupBy("root").agg((F.max("pos") + 1).alias("_top"))
    known = records.join(last, ["root", "path"], "left").select(
        "root", "path", F.coalesce("_size", "size").alias("size"), F.col("pos").cast("long").alias("pos"),
    )
    added = numbered(last.join(records.select("root", "path"), ["root", "path"], "left_anti"), ["root"], [F.col("_first"), F.col("path")], "_k")
    added = added.join(top, "root", "left").select(
        "root", "path", F.col("_size").alias("size"),
        (F.coalesce("_top", F.lit(0)) + F.col("_k")).cast("long").alias("pos"),
    )
    return known.unionByName(added)


def apply_removes(records: DataFrame, removed: DataFrame) -> DataFrame:
    return records.join(removed.select("id"), "id", "left_anti")


def fold(records: DataFrame, events: DataFrame) -> DataFrame:
    """Records after upserts and removes of the current generation: per path the last event decides."""
    last = current_generation(events).where("kind in ('upsert', 'remove')").groupBy("path").agg(F.max_by(F.struct("kind", "size"), "seq").alias("e"))
    out = records.join(last, "path", "full_outer").where("e is null or e.kind = 'upsert'")
    return out.select("path", F.coalesce("e.size", "size").alias("size"))


def dedup_requests(requests: DataFrame) -> DataFrame:
    """One request per (generation, epoch, key, priority), the first; only prefetch has epochs."""
    epoch = F.when(F.col("priority") == "prefetch", F.col("epoch")).otherwise(F.lit(0)).cast("long")
    return requests.withColumn("epoch", epoch).groupBy("generation", "epoch", "key", "priority").agg(F.min("seq").alias("seq"))


def valid_epochs(requests: DataFrame) -> DataFrame:
    now = requests.groupBy("generation").agg(F.max("epoch").alias("_now"))
    return requests.join(now, "generation").where("priority <> 'prefetch' or epoch = _now").drop("_now")


def queue_caps(requests: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Requests that find room in their queue, in order of arrival: a bounded top-n for each priority."""
    return reduce(DataFrame.unionByName, [requests.where(F.col("priority") == p).orderBy("seq").limit(n) for p, n in caps.items()])


def next_requests(requests: DataFrame, k: int) -> DataFrame:
    order = F.when(F.col("priority") == "preview", 0).when(F.col("priority") == "visible", 1).otherwise(2)
    return requests.withColumn("rank", order).orderBy("rank", "seq").limit(k)


def fire_times(bursts: DataFrame, busy: DataFrame, gap: str = "6 hours") -> DataFrame:
    """When each burst starts a scan: a gap after its last event, or when the work (user_id, busy_from, busy_until) that runs then ends.

    Pieces of work of one root don't overlap.
    """
    due = bursts.withColumn("fire_ts", F.col("last_ts") + F.expr(f"interval {gap}"))
    at = (F.col("fire_ts") >= F.col("busy_from")) & (F.col("fire_ts") < F.col("busy_until"))
    work = busy.withColumnRenamed("user_id", "_user")
    out = due.join(work, (F.col("user_id") == F.col("_user")) & at, "left")
    return out.withColumn("fire_ts", F.coalesce("busy_until", "fire_ts")).drop("_user", "busy_from", "busy_until")


def debounce(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Bursts of changes of a root: an event opens a new one if it comes a whole gap after the last."""
    w = F.session_window("ts", gap)
    out = events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.drop("w")
