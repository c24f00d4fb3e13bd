"""Stateful streams against batches and loops, changes of folders, the file sink, headers anywhere in a file."""

import os
import struct
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import caches, catalog, events
from strandloom.plans import catalog_queries as q
from strandloom.schema import CATALOG
from strandloom.sources import files, sink
from strandloom.streaming import streams

D = "/root/testdata/sf0.001"
EVENT = "root string, generation long, kind string, path string, size long, seq long"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(minutes):
    return T0 + timedelta(minutes=int(minutes))


# --- event reducer


def log_of_events(rng, root, n=120):
    """A log whose generation grows, with events of older generations that come late."""
    rows, generation = [], 0
    for seq in range(n):
        if seq % 40 == 0:
            generation += 1
            rows.append((root, generation, "started", None, None, seq))
        else:
            g = generation - int(rng.random() < 0.2)
            rows.append((root, g, str(rng.choice(["upsert", "upsert", "remove"])), f"p{rng.integers(0, 12)}", int(rng.integers(0, 99)), seq))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_reducer_equals_the_fold_after_any_split_and_a_restart(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    rows = [r for root in ("/a", "/b", "/c") for r in log_of_events(rng, root)]
    rows.sort(key=lambda r: r[5])
    if seed:  # rows of neighbours in another order, and some again
        rows = [rows[k] for k in np.argsort(np.arange(len(rows)) + rng.integers(0, 9, len(rows)), kind="stable")]
        rows += rows[-30:]
    cuts = sorted(rng.choice(np.arange(1, len(rows)), 4, replace=False).tolist())
    edges = [0, *cuts, len(rows)]
    for k in range(5):
        spark.createDataFrame(rows[edges[k] : edges[k + 1]], EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        if k in (2, 4):  # ended, and begun again from its checkpoint
            stream = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            out = stream.groupBy("root").transformWithStateInPandas(streams.Reducer(), streams.REDUCED, "update", "none")
            keep = lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")
            out.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = streams.records(spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out"))
    for root in ("/a", "/b", "/c"):
        own = spark.createDataFrame([r[1:] for r in set(rows) if r[0] == root], "generation long, kind string, path string, size long, seq long")
        want = events.fold(spark.createDataFrame([], "path string, size long"), own)
        assert {(r.path, r.size) for r in got.where(F.col("root") == root).collect()} == {(r.path, r.size) for r in want.collect()}


# --- the gate


def fired(rows, gap):
    """A plain loop over minutes, for rows (minute, kind, until)."""
    out, due, first, last, n = [], None, 0, 0, 0
    end = max([r[0] for r in rows] + [r[2] for r in rows if r[2]]) + gap + 2
    for t in range(end):
        busy = any(k == "work" and a <= t < b for a, k, b in rows)
        if due is not None and t >= due and not busy:
            out.append((first, last, n, t))
            due, n = None, 0
        for a, k, _ in rows:
            if k == "change" and a == t:
                first, last, n, due = first if n else t, t, n + 1, t + gap
    return out


@pytest.mark.parametrize("seed", range(2))
def test_gate_equals_a_loop_with_overlapping_work(spark, tmp_path, seed):
    rng = np.random.default_rng(seed + 5)
    rows = []
    for user in range(4):
        for _ in range(25):
            a = int(rng.integers(0, 600))
            rows.append((user, a, "change", None) if rng.random() < 0.7 else (user, a, "work", a + int(rng.integers(1, 60))))
    rows.sort(key=lambda r: r[1])
    edges = [0, 30, 31, 70, len(rows)]
    schema = "user_id long, ts timestamp, kind string, until timestamp"
    for k in range(4):
        part = [(u, at(a), kind, None if b is None else at(b)) for u, a, kind, b in rows[edges[k] : edges[k + 1]]]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    spark.createDataFrame([(-1, at(90_000), "change", None)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    for path in sorted(os.listdir(f"{tmp_path}/in")):
        for f in os.listdir(f"{tmp_path}/in/{path}"):
            os.utime(f"{tmp_path}/in/{path}/{f}", (1_700_000_000 + int(path) * 10,) * 2)  # files come in this order
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = stream.withWatermark("ts", "1 minute").groupBy("user_id").transformWithStateInPandas(streams.Gate("20 minutes"), streams.FIRED, "append", "eventTime")
    out.writeStream.format("memory").queryName(f"fired{seed}").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    minute = lambda x: round((x.replace(tzinfo=timezone.utc) - T0).total_seconds() / 60)
    got = sorted((r.user_id, minute(r.first_ts), minute(r.last_ts), r.n, minute(r.fire_ts)) for r in spark.table(f"fired{seed}").selectExpr("user_id", "cast(first_ts as timestamp_ntz) first_ts", "cast(last_ts as timestamp_ntz) last_ts", "n", "cast(fire_ts as timestamp_ntz) fire_ts").collect())
    want = sorted((u, *x) for u in range(4) for x in fired([r[1:] for r in rows if r[0] == u], 20))
    assert got == want and len(want) > 20


def test_pending_stream_equals_batch(spark, tmp_path):
    rows = q._requests(spark, D).withColumn("ts", F.timestamp_seconds(F.col("seq")))
    rows.repartitionByRange(3, "seq").sortWithinPartitions("seq").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    out = streams.pending_stream(stream, "1 hour").writeStream.format("memory").queryName("pending").outputMode("append")
    out.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    key = lambda r: (r.generation, r.epoch, r.key, r.priority)
    found = spark.table("pending").collect()
    assert len(found) == len({key(r) for r in found}) and {key(r) for r in found} == {key(r) for r in events.dedup_requests(rows).collect()}


def test_metadata_in_micro_batches(spark, tmp_path):
    base = q._placed(spark, D).drop("pos")
    new = base.limit(3).selectExpr("id", "path", "modified_ns", "11 as width", "12 as height", "1L as seq")
    late = base.limit(2).selectExpr("id", "path", "modified_ns - 1 as modified_ns", "5 as width", "5 as height", "2L as seq")
    for k, part in enumerate((new, late, new.withColumn("seq", F.lit(0).cast("long")).withColumn("width", F.lit(1)))):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):  # a second start finds nothing new
            stream = spark.readStream.schema(new.schema).parquet(f"{tmp_path}/in")
            streams.write_metadata(stream, f"{tmp_path}/applied", f"{tmp_path}/cp").awaitTermination()
    got = streams.with_metadata(base, f"{tmp_path}/applied")
    assert got.count() == base.count() and got.where("width = 11 and height = 12").count() >= 3 and got.where("width = 5 and height = 5").count() == base.where("width = 5 and height = 5").count()


# --- changes of folders


def test_changes_between_walks(spark, tmp_path):
    """Deletions, replacements with equal or older times, moves; once each, also after a restart."""
    root, folder = tmp_path / "t", f"file://{tmp_path}/watch"
    (root / "sub").mkdir(parents=True)
    for k in range(6):
        (root / "sub" / f"f{k}.jpg").write_text("x" * k)

    def step():
        files.watch(spark, str(root), folder, once=True).awaitTermination()

    step()
    f = root / "sub"
    (f / "f0.jpg").unlink()
    was = os.stat(f / "f1.jpg").st_mtime_ns
    (f / "new").write_text("y")
    os.replace(f / "new", f / "f1.jpg")  # as large and as old as before, but another file
    os.utime(f / "f1.jpg", ns=(was, was))
    os.utime(f / "f2.jpg", ns=(10**18, 10**18))  # older than all that was seen
    (root / "made.txt").write_text("z")
    (root / "other").mkdir()
    os.rename(f / "f3.jpg", root / "other" / "moved.jpg")
    step()
    step()
    (root / "other" / "moved.jpg").unlink()
    os.rmdir(root / "other")
    step()
    got = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/changes").orderBy("batch", "path").collect()
    short = [(r.batch, r.event_type, os.path.basename(r.path), r.from_path and os.path.basename(r.from_path)) for r in got]
    assert short == [
        (1, "create", "made.txt", None), (1, "move", "moved.jpg", "f3.jpg"), (1, "remove", "f0.jpg", None), (1, "modify", "f1.jpg", None),
        (1, "modify", "f2.jpg", None), (3, "remove", "moved.jpg", None),
    ]
    out = files.change_stream(spark, folder).writeStream.format("memory").queryName("changed").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    out.awaitTermination()
    assert spark.table("changed").count() == 6 and len(os.listdir(tmp_path / "watch" / "snapshots")) <= 3


def test_changes_after_a_walk_with_errors(spark):
    schema = "path string, size long, modified_ns long, inode long"
    old = spark.createDataFrame([("/a", 1, 1, 1), ("/b", 1, 1, 2)], schema)
    now = spark.createDataFrame([("/a", 2, 1, 1), ("/c", 1, 1, 2)], schema)
    kinds = lambda n: sorted((r.path, r.event_type) for r in files.changes(old, now, n).collect())
    assert kinds(0) == [("/a", "modify"), ("/c", "move")] and kinds(1) == [("/a", "modify"), ("/c", "create")]
    links = spark.createDataFrame([(f"/l{k}", 1, 1, 7) for k in range(3)], schema)
    more = spark.createDataFrame([(f"/m{k}", 1, 1, 7) for k in range(2)], schema)
    found = sorted((r.event_type, r.path, r.from_path) for r in files.changes(links, more).collect())
    assert found == [("move", "/m0", "/l0"), ("move", "/m1", "/l1"), ("remove", "/l2", None)]
    assert files.changes(old.limit(0), now.limit(0)).collect() == []


def test_walk_of_a_deep_chain_and_a_full_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FIRST_FOLDERS", 2)
    monkeypatch.setattr(files, "MORE", 4)
    here = tmp_path
    for _ in range(150):  # as deep as a path's length allows
        here = here / "d"
        here.mkdir()
    (here / "last.jpg").write_text("")
    (tmp_path / "full").mkdir()
    for k in range(25_000):
        (tmp_path / "full" / str(k)).touch()
    tree = files.scan_tree(spark, str(tmp_path))
    assert tree.count() == 1 + 150 + 1 + 1 + 25_000 == tree.select("path").distinct().count()
    with pytest.raises(Exception, match="no such folder|No such file"):
        files.scan_tree(spark, str(tmp_path / "no such folder"))


# --- the sink


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    folder = str(tmp_path / "cache")
    rows = spark.createDataFrame([(f"e{k}.rgba", b"x" * k) for k in range(40)], "name string, content binary").repartition(4)
    sink.write_files(rows, folder)
    before = {n: os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder) if n.endswith(".rgba")}
    bad = rows.withColumn("name", F.when(F.col("name") == "e7.rgba", "../out").otherwise(F.concat(F.lit("n"), "name")))
    with pytest.raises(Exception, match="below the folder"):
        sink.write_files(bad, folder)
    assert {n: os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder) if n.endswith(".rgba")} == before
    assert not os.listdir(f"{folder}/{sink.STAGED}") and not (tmp_path / "out").exists()


def test_growth_of_the_cache_equals_the_plan(spark, tmp_path):
    folder = str(tmp_path / "cache")
    one = spark.createDataFrame([(f"e{k}", b"x" * 10) for k in range(30)], "name string, content binary")
    two = spark.createDataFrame([(f"e{k}", b"x" * k) for k in range(20, 50)] + [("none", None)], "name string, content binary")
    sink.write_files(one, folder)
    sink.write_files(two.repartition(3), folder)
    sizes = lambda df: df.where("content is not null").select(F.col("name").alias("path"), F.octet_length("content").cast("long").alias("size"))
    want = caches.write_delta(sizes(one), sizes(two)).agg(F.sum("delta")).first()[0]
    got = {(r.files, r.bytes, r.delta, r.stale) for r in sink.commits(spark, folder).collect()}
    assert got == {(30, 300, 300, False), (30, sum(range(20, 50)), want, False)}
    assert sink.cache_files(spark, folder, "e*").agg(F.sum("size")).first()[0] == 300 + want
    writer = sink._Writer(folder)
    staged = writer.write(iter([{"name": "late", "content": b"late"}]))
    sink.clear(folder)
    writer.commit([staged])  # of before the cache was cleared
    assert not [n for n in os.listdir(folder) if not n.startswith(".")]


# --- headers


def tiff(order, width, height, gap, turn=1):
    """A file whose directory lies behind ``gap`` bytes of pixels."""
    mark = b"II*\0" if order == "<" else b"MM\0*"
    entry = lambda tag, kind, value: struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
    tags = entry(256, 4, width) + entry(257, 3, height) + entry(274, 3, turn)
    return mark + struct.pack(order + "I", 8 + gap) + b"\0" * gap + struct.pack(order + "H", 3) + tags


def jpeg(width, height, gap):
    segments = b"".join(b"\xff\xe2" + struct.pack(">H", 65_535) + b"\0" * 65_533 for _ in range(gap))
    return b"\xff\xd8" + segments + b"\xff\xff\xc0" + struct.pack(">HBHH", 17, 8, height, width) + b"\0" * 20


def test_headers_anywhere_in_a_file(spark, tmp_path):
    made = {
        "a.tif": (tiff("<", 40, 30, 0), (40, 30)), "b.tif": (tiff(">", 4000, 3000, 3_000_000), (4000, 3000)), "c.tif": (tiff("<", 7, 9, 200_001, 6), (9, 7)),
        "d.jpg": (jpeg(640, 480, 0), (640, 480)), "e.jpg": (jpeg(641, 481, 30), (641, 481)), "f.tif": (tiff("<", 1, 1, 50)[:40], None), "g.jpg": (b"\xff\xd8\xff", None),
        "h.jpg": (b"\xff\xd8" + b"\0" * 50, None), "i.tif": (b"II*\0" + b"\xff" * 4, None), "j.jpg": (b"\xff\xd8\xff\xe0\0\0" * 9, None),
    }
    for name, (data, want) in made.items():
        (tmp_path / name).write_bytes(data)
        assert files.dimensions(data) == want
    got = {os.path.basename(r.path): r.width and (r.width, r.height) for r in files.image_dims(files.scan_files(spark, str(tmp_path))).collect()}
    assert got == {name: want for name, (_, want) in made.items()}


# --- the catalog


def entries(spark, rows):
    values = [("r", p, p, p, size, ns, "jpg", "k") for p, size, ns in rows]
    return spark.createDataFrame(values, "root string, path string, relative_path string, file_name string, size long, modified_ns long, format string, thumbnail_key string")


def test_upsert_of_repeated_keys(spark):
    """The last by time counts, then the greatest; one row and one id for each key."""
    none = q.keyed(q._placed(spark, D).drop("pos")).limit(0)
    first = catalog.upsert(none, entries(spark, [("/a", 1, 1)]))
    new = entries(spark, [("/a", 2, 5), ("/a", 3, 4), ("/b", 7, 2), ("/b", 7, 2), ("/b", 6, 2)])
    got = sorted((r.path, r.id, r.size) for r in catalog.upsert(first, new).collect())
    assert got == [("/a", 1, 2), ("/b", 2, 7)]
    by = catalog.upsert(first, new.withColumn("seq", F.col("size") * -1), order="seq")
    assert sorted((r.path, r.size) for r in by.collect()) == [("/a", 2), ("/b", 6)]
    assert catalog.key_violations(catalog.upsert(first, new)).count() == 0


def test_scan_counts_what_it_does(spark):
    none = q.keyed(q._placed(spark, D).drop("pos")).limit(0)
    walk = lambda rows, error: entries(spark, rows).withColumn("error", F.lit(False)).unionByName(spark.createDataFrame([(True,)] * error, "error boolean"), allowMissingColumns=True)

    def done(old, rows, error=0):
        out, stats = catalog.scan(old, walk(rows, error))
        assert stats.pop("elapsed_ms") >= 0
        return out, stats

    first, stats = done(none, [("/a", 1, 1), ("/b", 1, 1), ("/c", 1, 1)])
    assert stats == {"visited": 3, "supported": 3, "errors": 0, "reused": 0, "inserted": 3, "updated": 0, "removed": 0, "total": 3}
    same, stats = done(first, [("/a", 1, 1), ("/b", 1, 1), ("/c", 1, 1)])
    assert stats["reused"] == 3 and same.exceptAll(first).count() == 0 == first.exceptAll(same).count()
    kept, stats = done(first, [("/a", 2, 1), ("/d", 1, 1), ("/e", None, 1)], 2)
    assert stats == {"visited": 3, "supported": 3, "errors": 2, "reused": 0, "inserted": 1, "updated": 1, "removed": 0, "total": 5}
    assert sorted((r.path, r.id, r.size) for r in kept.collect()) == [("/a", 1, 2), ("/b", 2, 1), ("/c", 3, 1), ("/d", 4, 1)]
    less, stats = done(kept, [("/b", None, 1)])
    assert stats["removed"] == 3 and stats["total"] == 1 and [(r.path, r.id) for r in less.collect()] == [("/b", 2)]


def test_scan_of_an_empty_folder(spark):
    """Counts come out where nothing flows through the plan: no files, none that is supported, no catalog."""
    none = spark.createDataFrame([], CATALOG)
    nothing = entries(spark, [("/a", 1, 1)]).withColumn("error", F.lit(False)).limit(0)
    static = spark.createDataFrame([], nothing.schema)
    other = entries(spark, [("/a.txt", 1, 1)]).withColumn("format", F.lit("txt")).withColumn("error", F.lit(False))
    for walk, visited in ((nothing, 0), (static, 0), (other, 1)):
        rows, stats = catalog.scan(none, walk)
        assert rows.collect() == [] and stats["visited"] == visited and stats["supported"] == stats["total"] == stats["removed"] == 0
    assert spark.conf.get("spark.sql.optimizer.excludedRules", None) is None


def test_truncated_table(spark, tmp_path):
    spark.sql(f"create database tables_of_test location '{tmp_path}/db'")
    q._placed(spark, D).write.partitionBy("root").saveAsTable("tables_of_test.catalog")
    assert catalog.table_exists(spark, "tables_of_test.catalog") and spark.table("tables_of_test.catalog").count()
    catalog.truncate(spark, "tables_of_test.catalog")
    assert spark.table("tables_of_test.catalog").count() == 0
    spark.sql("drop database tables_of_test cascade")
