"""Structured Streaming forms: debounce and its gate, throttle, micro-batched metadata, event reducer, pending requests, cancellation."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from strandloom.operators.catalog import update_metadata
from strandloom.operators.ordering import running_before
from strandloom.operators.scratch import saved


def changes(events: DataFrame) -> DataFrame:
    """Change events that call for a scan: all but mere access."""
    return events.where("event_type <> 'view'")


def debounce_stream(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Bursts per root; run it in append mode; a burst comes out once the watermark has passed it, so the last one waits for later events."""
    w = F.session_window("ts", gap)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def _kept(frame: pd.DataFrame, last, step: pd.Timedelta):
    keep = []
    for ts in frame["ts"]:
        go = last is None or ts - last >= step
        last = ts if go else last
        keep.append(go)
    return frame[keep], last


#: Events of a run that a task follows by itself.
RUN = 65_536


def _followed(batches):
    """Runs of events in a row: where each begins, each event's successor, and the first one after the run that it leads to."""
    for batch in batches:
        at, to = batch.column("at").to_numpy(), batch.column("to").to_numpy()
        cuts = np.flatnonzero(np.diff(at) != 1) + 1
        edges = [0, *cuts.tolist(), len(at)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            for k in range(lo, hi, RUN):
                own, start = to[k : min(k + RUN, hi)], int(at[k])
                leads = own.copy()
                while (inside := leads < start + len(own)).any():  # each step doubles how far an event looks
                    leads[inside] = leads[leads[inside] - start]
                yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([own]), pa.array([leads])], ["run", "to", "leads"])


def _marked(batches):
    """Positions on the paths that begin at a run's entries, up to its end."""
    for batch in batches:
        for start, to, entries in zip(*(batch.column(c).to_pylist() for c in ("run", "to", "entries")), strict=True):
            seen = np.zeros(len(to), bool)
            for at in entries:
                while at < start + len(to) and not seen[at - start]:
                    seen[at - start] = True
                    at = to[at - start]
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen) + start)], ["at"])


def throttle(events: DataFrame, key: str = "user_id", interval: str = "6 hours") -> DataFrame:
    """Events that are shown: the first of a key, then each that comes a whole interval after the last one shown.

    Every event has one successor, the first of its key a whole interval later, whether it
    is shown or not. Events and their times an interval on are put in one order by
    range partitions; the events before such a time are the successor's position. (After
    a key's last event that is the next key's first one, which is shown anyway.) Runs of events
    are followed to their ends by themselves; from run to run pointers are doubled, in as
    many rounds as the logarithm of the runs of a key. A key's events may be in any number of tasks.

    Events without a time are not shown. Of events at one time that with the least event_id is first.
    """
    base = events.select("event_id", key, "ts").where("ts is not null")
    later = base.withColumn("_t", F.col("ts") + F.expr(f"interval {interval}")).withColumn("_event", F.lit(0))
    both = base.withColumn("_t", F.col("ts")).withColumn("_event", F.lit(1)).unionByName(later)
    placed = running_before(both, [], [F.col(key), F.col("_t"), F.col("_event"), F.col("event_id")], "to", "_event", "_row")
    placed = placed.where("_event = 0").select("event_id", key, "ts", (F.col("_row") - F.col("to")).alias("at"), "to")
    placed = saved(placed)  # an event's time an interval on has the event's own place among such times
    runs = saved(placed.select("at", "to").mapInArrow(_followed, "run long, to array<long>, leads array<long>"))
    each = runs.select("run", F.posexplode("leads").alias("_k", "leads")).select((F.col("run") + F.col("_k")).alias("at"), "run", "leads")
    starts = placed.groupBy(key).agg(F.min("at").alias("at")).select("at")
    reached = starts
    hops = saved(each.join(each.select(F.col("leads").alias("at")).unionByName(starts).distinct(), "at", "left_semi"))
    jump, n = hops.select("at", "leads"), 0
    while True:
        reached = saved(reached.join(hops.select("at"), "at", "left_semi").distinct())
        now = reached.count()
        if now == n:
            break
        n = now
        reached = reached.unionByName(reached.join(jump, "at").select(F.col("leads").alias("at")))
        twice = jump.select("at", F.col("leads").alias("_via")).join(jump.select(F.col("at").alias("_via"), "leads"), "_via")
        jump = saved(twice.select("at", "leads"))
    entries = reached.join(hops, "at").groupBy("run").agg(F.collect_list("at").alias("entries"))  # a run's events at most
    shown = runs.select("run", "to").join(entries, "run").mapInArrow(_marked, "at long")
    return placed.join(shown, "at", "left_semi").select("event_id", key, "ts")


class Throttle(StatefulProcessor):
    """The same for streams, with the time last shown as state: events.groupBy(key).transformWithStateInPandas."""

    def __init__(self, interval: str):
        self.step = pd.Timedelta(interval)

    def init(self, handle):
        self.state = handle.getValueState("last", "ts timestamp")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        last = pd.Timestamp(self.state.get()[0]) if self.state.exists() else None
        for frame in rows:
            kept, last = _kept(frame.sort_values(["ts", "event_id"]), last, self.step)
            yield kept
        if last is not None:
            self.state.update((last.to_pydatetime(),))

    def close(self):
        pass


def write_metadata(updates: DataFrame, folder: str, checkpoint: str, **trigger):
    """Micro-batches of metadata updates, appended to a table below ``folder``, each once; ``with_metadata`` merges them on reading."""
    out = updates.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return out.trigger(**trigger or {"availableNow": True}).start()


def with_metadata(catalog: DataFrame, folder: str) -> DataFrame:
    """The catalog with the updates that were written below ``folder``, each guarded: of several that fit a row the last by seq."""
    return update_metadata(catalog, catalog.sparkSession.read.parquet(folder))


class Reducer(StatefulProcessor):
    """Events of a root folded into its records: events.groupBy("root").transformWithStateInPandas(Reducer(), REDUCED, "update", "none").

    Rows: root, generation, kind (started, upsert, remove), path, size, seq. The state is the
    generation that was started last and, for each path, what its last event of this generation
    or of one not yet started said. A new generation drops the paths of older ones, and events of
    older generations fall out, however late they come. Of two events of a path that with the
    greater seq counts, so rows may come in any order and again. With ``ttl`` (milliseconds) paths
    without events for so long are forgotten; it takes the time mode "processingTime", whose streams run on
    until they are stopped. What comes out is each path whose record changed; ``records`` makes a table of it.
    """

    def __init__(self, ttl: int | None = None):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.now = handle.getValueState("now", "generation long, seq long")
        self.files = handle.getMapState("files", "generation long, path string", "size long, seq long", self.ttl)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        batch = pd.concat(list(rows), ignore_index=True)
        now, since = self.now.get() if self.now.exists() else (None, None)
        started = batch[batch["kind"] == "started"].sort_values("seq")
        fresh = len(started) and (since is None or int(started["seq"].iloc[-1]) > since)
        changed = {}
        if fresh:
            before, now, since = now, int(started["generation"].iloc[-1]), int(started["seq"].iloc[-1])
            self.now.update((now, since))
            if before != now:
                for generation, path in [tuple(k) for k in self.files.keys()]:
                    if generation < now:
                        self.files.removeKey((generation, path))
                    elif generation == now:  # what came before the generation was started
                        changed[path] = self.files.getValue((generation, path))
        events = batch[batch["kind"].isin(["upsert", "remove"])]
        if now is not None:
            events = events[events["generation"] >= now]
        last = events.sort_values("seq").drop_duplicates(["generation", "path"], keep="last")
        for generation, path, kind, size, seq in last[["generation", "path", "kind", "size", "seq"]].itertuples(index=False):
            at = (int(generation), path)
            if self.files.containsKey(at) and self.files.getValue(at)[1] >= seq:
                continue
            value = (int(size) if kind == "upsert" and not pd.isna(size) else None, int(seq))
            self.files.updateValue(at, value)
            if generation == now:
                changed[path] = value
        columns = ["root", "generation", "path", "size", "seq"]
        out = pd.DataFrame([(key[0], now, path, v[0], v[1]) for path, v in changed.items()], columns=columns)
        yield out.astype({"size": "Int64", "generation": "Int64", "seq": "Int64"})

    def close(self) -> None:
        pass


#: What ``Reducer`` gives: size is null where the path was removed.
REDUCED = "root string, generation long, path string, size long, seq long"


def records(reduced: DataFrame) -> DataFrame:
    """The records of each root's last generation, from all that a ``Reducer`` gave."""
    last = reduced.groupBy("root", "generation", "path").agg(F.max_by("size", "seq").alias("size"))
    now = last.groupBy("root").agg(F.max("generation").alias("_now"))
    return last.join(now, "root").where("generation = _now and size is not null").select("root", "path", "size")


class Gate(StatefulProcessor):
    """Trailing debounce that waits while work runs: rows.groupBy("user_id").transformWithStateInPandas(Gate("6 hours"), FIRED, "append", "eventTime").

    Rows: user_id, ts (with a watermark), kind, until. A ``change`` sets the key due a gap after its
    time, anew with each one. A ``work`` is busy from ts to until; pieces may overlap. When the due time has
    passed and nothing is busy, the key fires, once for all changes since it last did. A change
    at the very time of firing comes after it, work that begins then comes before. Events wait
    in state until the watermark has passed them, so their order is that of their
    times; a timer stands at the next event or time of firing, and is set again as work goes on.
    """

    def __init__(self, gap: str):
        self.gap = int(pd.Timedelta(gap).value // 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "data string")

    def _load(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else {"waiting": [], "due": None, "first": 0, "last": 0, "n": 0, "busy": None}

    def _store(self, s: dict) -> None:
        times = [w[0] for w in s["waiting"]] + ([max(s["due"], s["busy"] or s["due"])] if s["due"] is not None else [])
        if times:
            self.handle.registerTimer(-(-min(times) // 1000))
        self.state.update((json.dumps(s),))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        s = self._load()
        micros = lambda x: None if pd.isna(x) else int(pd.Timestamp(x).value // 1000)
        for frame in rows:
            s["waiting"] += [[micros(ts), int(kind != "work"), micros(until)] for ts, kind, until in frame[["ts", "kind", "until"]].itertuples(index=False)]
        self._store(s)
        yield pd.DataFrame(columns=["user_id", "first_ts", "last_ts", "n", "fire_ts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        s, upto = self._load(), timerValues.getCurrentWatermarkInMs() * 1000
        ready = sorted((w for w in s["waiting"] if w[0] <= upto), key=lambda w: (w[0], w[1]))
        s["waiting"] = [w for w in s["waiting"] if w[0] > upto]
        fired: list = []

        def fire(before: int) -> None:
            if s["due"] is not None and (at := max(s["due"], s["busy"] or s["due"])) < before:
                fired.append((key[0], s["first"], s["last"], s["n"], at))
                s.update(due=None, n=0)

        for ts, change, until in ready:
            fire(ts + change)
            if change:
                s.update(first=s["first"] if s["n"] else ts, last=ts, n=s["n"] + 1, due=ts + self.gap)
            else:
                s["busy"] = max(s["busy"] or until, until)
        fire(upto + 1)
        if s["due"] is None and not s["waiting"] and (s["busy"] or 0) <= upto:
            self.state.clear()
        else:
            self._store(s)
        out = pd.DataFrame(fired, columns=["user_id", "first_ts", "last_ts", "n", "fire_ts"])
        for c in ("first_ts", "last_ts", "fire_ts"):
            out[c] = pd.to_datetime(out[c], unit="us")
        yield out

    def close(self) -> None:
        pass


FIRED = "user_id long, first_ts timestamp, last_ts timestamp, n long, fire_ts timestamp"


def pending_stream(requests: DataFrame, late: str = "1 minute") -> DataFrame:
    """Requests (with ts) that are not pending already: of those of one (generation, epoch, key, priority) the first, as long as its watermark lasts.

    Only prefetch has epochs. State holds the keys of the time that the watermark allows.
    """
    epoch = F.when(F.col("priority") == "prefetch", F.col("epoch")).otherwise(F.lit(0)).cast("long")
    rows = requests.withColumn("epoch", epoch).withWatermark("ts", late)
    return rows.dropDuplicatesWithinWatermark(["generation", "epoch", "key", "priority"])


def cancel(spark, tag: str) -> None:
    """Stop the jobs of a superseded scan or sort: those of threads that called ``spark.sparkContext.addJobTag(tag)``."""
    spark.sparkContext.cancelJobsWithTag(tag)
