import os
import shutil
import subprocess
import sys
import threading
import time

import duckdb
import numpy as np
import pytest

from strandloom.functions import scalars as S
from strandloom.operators import catalog, transfers
from strandloom.plans import catalog_queries as q
from strandloom.sources.files import dimensions, image_dims, scan_files, scan_tree
from strandloom.streaming import streams

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([round(x, 9) if isinstance(x, float) else x for x in (r[k] for k in order)]) for r in found)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_equals_sql(spark, duck, name):
    df = q.QUERIES[name](spark, D)
    c = duck.execute(q.SQL[name])
    columns = [x[0] for x in c.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, c.fetchall())


def test_natural_order(spark):
    names = ["image10.jpg", "Image2.jpg", "image1.jpg", "image0002.jpg"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(S.natural_key(df.n), df.n).collect()]
    assert got == ["image1.jpg", "Image2.jpg", "image0002.jpg", "image10.jpg"]


def test_extensions(spark):
    df = spark.createDataFrame([(x,) for x in (".jpg", "a.", "x.tar.PNG", "a.JPG", "b.heic")], "n string")
    assert [r[0] for r in df.select(S.extension_lower(df.n)).collect()] == ["", "", "png", "jpg", "heic"]
    assert [r[0] for r in df.select(S.supported(df.n)).collect()] == [False, False, True, True, False]


def test_format_bytes(spark):
    df = spark.createDataFrame([(x,) for x in (1023, 1024, 1280, 1 << 20, 1 << 30)], "n long")
    assert [r[0] for r in df.select(S.format_bytes(df.n)).collect()] == ["1023 B", "1.0 KiB", "1.2 KiB", "1.0 MiB", "1.00 GiB"]


def one_after_the_other(items, there, most=99_999):
    """Targets of items (seq, file_name, policy), each in its turn."""
    used, out = {x.lower() for x in there}, {}
    for seq, name, policy in sorted(items):
        target, exhausted = name, False
        if name.lower() in used:
            if policy in ("ask", "skip"):
                target = None
            elif policy == "auto_rename":
                dot = name.rfind(".")
                stem, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
                free = next((k for k in range(1, most + 1) if f"{stem} ({k}){ext}".lower() not in used), None)
                exhausted = free is None
                target = None if exhausted else f"{stem} ({free}){ext}"
        if target is not None:
            used.add(target.lower())
        out[seq] = (target, exhausted)
    return out


def renamed(spark, items, there, most=99_999):
    found = transfers.auto_rename(
        spark.createDataFrame(items, "seq long, file_name string, policy string"), spark.createDataFrame([(n,) for n in there], "name string"), most,
    )
    return {r.seq: (r.target, r.exhausted) for r in found.collect()}


def test_auto_rename_equals_a_sequential_run(spark):
    names = ["a.jpg", "A.JPG", "a (1).jpg", "a (1) (1).jpg", "a.jpg", "b", "B", ".x", ".x", "a (1).jpg", " (1).jpg", ".jpg", ".jpg", "a (01).jpg", "c.", "C.", "x.y (1)", "x.y", "X.Y"]
    items = [(k, n, ("auto_rename", "skip", "overwrite")[k % 7 % 3]) for k, n in enumerate(names)]
    there = ["a.jpg", "b (1)"]
    assert renamed(spark, items, there) == one_after_the_other(items, there)
    every = [(k, n, "auto_rename") for k, n in enumerate(names * 2)]
    assert renamed(spark, every, there) == one_after_the_other(every, there)
    assert renamed(spark, [], there) == {}


@pytest.mark.parametrize("seed", range(2))
def test_auto_rename_of_names_that_meet_numbered_ones(spark, seed):
    """Items that ask for numbered names before and after the count comes to them, some in the folder, up to the last number."""
    rng = np.random.default_rng(seed)
    part = lambda: "" if rng.random() < 0.5 else f" ({rng.integers(1, 9)})"
    names = [f"{rng.choice(['a', 'A', 'b.c'])}{part()}{part() if rng.random() < 0.4 else ''}{rng.choice(['.jpg', '.JPG', ''])}" for _ in range(400)]
    items = [(int(k) * 3, n, str(rng.choice(["auto_rename"] * 6 + ["skip", "overwrite", "ask"]))) for k, n in zip(rng.permutation(400), names)]
    there = [f"a ({k}).jpg" for k in range(1, 30, 4)] + ["b.c", "a (2) (3)"]
    for most in (99_999, 25):
        assert renamed(spark, items, there, most) == one_after_the_other(items, there, most)


def test_a_million_items_of_one_name_go_to_many_tasks(spark):
    """Each task sees a share of them, and the first 99,999 get numbers."""
    n = 1_000_000
    items = spark.range(n).selectExpr("id as seq", "if(id % 250000 = 7, concat('hot (', 5 + id div 250000, ').jpg'), 'hot.jpg') as file_name", "'auto_rename' as policy")
    out = transfers.auto_rename(items, spark.createDataFrame([("hot.jpg",), ("hot (2).jpg",)], "name string"))
    got = out.selectExpr("count(*) as n", "count(distinct target) as targets", "count_if(exhausted) as exhausted", "max(if(seq = 2, target, null)) as third", "max(if(seq = 500007, target, null)) as own").first()
    numbers = 99_999 - 1  # and four items that ask for a number after the count has passed it
    assert got.n == n and got.targets == numbers + 4 and got.exhausted == n - got.targets
    assert got.third == "hot (4).jpg" and got.own == "hot (7) (1).jpg"


def test_files(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    (tmp_path / "parent" / "child").mkdir(parents=True)
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / ".hidden.txt").write_text("x")
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (5).to_bytes(4, "big")
    (tmp_path / "full" / "a.png").write_bytes(png)
    os.symlink(tmp_path / "full", tmp_path / "loop")
    files = {os.path.basename(r.path): r for r in scan_files(spark, str(tmp_path)).collect()}
    assert set(files) == {".hidden.txt", "a.png"}
    assert files["a.png"].modified_ns == os.stat(tmp_path / "full" / "a.png").st_mtime_ns
    from pyspark.sql import functions as F

    from strandloom.operators.folders import empty_folders

    tree = scan_tree(spark, str(tmp_path))
    found = empty_folders(tree.where("is_dir").select("path", "error"), tree.where("parent is not null").select(F.col("parent")), str(tmp_path))
    assert {r.relative_path for r in found.collect()} == {"empty", "parent/child"}
    dims = image_dims(scan_files(spark, str(tmp_path))).collect()
    assert [(r.width, r.height) for r in dims if r.path.endswith("png")] == [(7, 5)]
    assert dimensions(b"junk") is None


def test_deep_and_wide_trees(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"a{k}" / "b" / "c").mkdir(parents=True)
        (tmp_path / f"a{k}" / "b" / "c" / "x.jpg").write_text(str(k))
        (tmp_path / f"a{k}" / "y.jpg").write_text("y")
    found = [r.path for r in scan_tree(spark, str(tmp_path)).collect()]
    assert len(found) == len(set(found)) == 1 + 300 * 5


def test_throttled_stream_equals_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{D}/events.parquet").selectExpr("event_id", "user_id", "cast(ts as timestamp) as ts")
    ev.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/in").groupBy("user_id")
    out = stream.transformWithStateInPandas(streams.Throttle("6 hours"), "event_id long, user_id long, ts timestamp", "append", "none")
    out.writeStream.outputMode("append").format("memory").queryName("shown").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start().awaitTermination()
    assert {r.event_id for r in spark.table("shown").collect()} == {r.event_id for r in streams.throttle(ev).collect()}


def test_cancelled_work_ends(spark):
    failed = []

    def work():
        spark.sparkContext.addJobTag("scan-7")
        try:
            spark.range(100).repartition(100).mapInPandas(slow, "id long").count()
        except Exception as e:
            failed.append(str(e))

    def slow(frames):
        time.sleep(1)
        yield from frames

    thread = threading.Thread(target=work)
    thread.start()
    time.sleep(4)
    streams.cancel(spark, "scan-7")
    thread.join(60)
    assert not thread.is_alive() and failed


def test_sync_keeps_what_it_could_not_read(spark, tmp_path):
    from strandloom.plans.fixtures import current, keyed

    def written(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    old = written(keyed(current(spark, D)), "old")
    walk = old.drop("id", "width", "height")
    first = written(catalog.sync(old.limit(0), walk), "first")
    assert first.count() == old.count() and first.select("id").distinct().count() == old.count()
    same = written(catalog.sync(first, walk), "same")
    assert same.exceptAll(first).count() == first.exceptAll(same).count() == 0
    blind = catalog.sync(first, walk.selectExpr("root", "path", "relative_path", "file_name", "cast(null as long) as size", "modified_ns", "format", "thumbnail_key"))
    assert blind.exceptAll(first).count() == 0 and blind.count() == first.count()
    error = spark.createDataFrame([("x",)], "e string")
    assert catalog.sync(first, walk.limit(0), error).count() == first.count() and catalog.sync(first, walk.limit(0), error.limit(0)).count() == 0


def test_upsert_of_fifty_thousand_rows(spark):
    rows = spark.range(50_000).selectExpr("'/r' as root", "concat('/r/image-', id, '.jpg') as path", "concat('image-', id, '.jpg') as relative_path", "concat('image-', id, '.jpg') as file_name", "id as size", "id as modified_ns", "'jpg' as format", "'k' as thumbnail_key")
    empty = q.keyed(q._placed(spark, D).drop("pos")).limit(0)
    catalog.upsert(empty, rows).count()
    began = time.time()
    assert catalog.upsert(empty, rows).agg({"id": "max"}).first()[0] == 50_000
    assert time.time() - began < 15


def test_numbers_of_ties_nulls_and_empty_tables(spark):
    from pyspark.sql import functions as F

    from strandloom.operators.ordering import numbered, running_before

    df = spark.range(3000).select(F.when(F.col("id") % 5 != 0, F.col("id") % 7).alias("k"), F.col("id").alias("v"), (F.col("id") % 3).alias("g"))
    got = numbered(df, ["g"], [F.col("k")], "n").collect()
    for g in range(3):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.n)
        assert [r.n for r in own] == list(range(1000))
        keys = [-1 if r.k is None else r.k for r in own]
        assert keys == sorted(keys)
    total = running_before(df, [], [F.col("k"), F.col("v")], "b", "v").orderBy("b", "v").collect()
    assert total[-1].b + total[-1].v == sum(range(3000))
    assert numbered(df.limit(0), ["g"], [F.col("k")], "n").count() == 0


def test_exhausted_names(spark):
    got = renamed(spark, [(k, "a.jpg", "auto_rename") for k in range(3)], [], 1)
    assert [got[k] for k in range(3)] == [("a.jpg", False), ("a (1).jpg", False), (None, True)]


def test_locations_and_workers(spark):
    from strandloom import schema

    assert [schema.decoder_threads(n) for n in (1, 4, 64)] == [2, 3, 8]
    assert schema.storage_locations("/x")["thumbnails"] == "/x/data/cache/thumbnails"
    assert not catalog.table_exists(spark, "no_such_table")


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", "tests")
    shutil.copytree(here, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e, sys; q = e.queries(); assert 'catalog_sync' in q and not any(k.startswith('op1_') or k == 'pipeline' for k in q) and len(e.oracle_sql()) > 60"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_debounce_stream_equals_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{D}/events.parquet").selectExpr("user_id", "cast(ts as timestamp) as ts")
    ev.unionByName(spark.sql("select -1L as user_id, timestamp'2034-01-01 00:00:00' as ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/in")
    out = streams.debounce_stream(stream).writeStream.outputMode("append").format("memory").queryName("bursts").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    out.awaitTermination()
    from strandloom.operators.events import debounce

    found = [{(r.user_id, r.first_ts, r.last_ts, r.n) for r in df.collect()} for df in (debounce(ev), spark.table("bursts"))]
    assert found[0] == found[1]


def test_throttle(spark):
    df = spark.createDataFrame([(k, 1, f"2024-01-01 {h:02d}:00:00") for k, h in enumerate((0, 3, 6, 7, 12, 17))], "event_id long, user_id long, t string").selectExpr("event_id", "user_id", "cast(t as timestamp) as ts")
    assert sorted(r.event_id for r in streams.throttle(df).collect()) == [0, 2, 4]


@pytest.mark.parametrize("run", [3, 65_536])
def test_throttle_equals_a_loop(spark, monkeypatch, run):
    """One key with half of all events, ties, null keys and times, runs of a few events and of many."""
    monkeypatch.setattr(streams, "RUN", run)
    rng = np.random.default_rng(run)
    when = lambda: None if rng.random() < 0.02 else int(rng.integers(0, 400)) * 900
    rows = [(k, [7, 7, 7, None, 1, 2, 3][k % 7], when()) for k in range(900)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long").selectExpr("event_id", "user_id", "timestamp_seconds(s) as ts").repartition(5)
    want, last = set(), {}
    for k, user, s in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        if user not in last or s - last[user] >= 6 * 3600:
            last[user] = s
            want.add(k)
    assert {r.event_id for r in streams.throttle(df).collect()} == want
    assert streams.throttle(df.limit(0)).collect() == []


def test_removals_need_a_clean_scan(spark):
    prev = q._placed(spark, D)
    cur = prev.where("id % 2 = 0")
    none = spark.createDataFrame([], "e string")
    assert catalog.removed_paths(cur, prev, none).count() == prev.where("id % 2 <> 0").count()
    assert catalog.removed_paths(cur, prev, spark.createDataFrame([("x",)], "e string")).count() == 0
