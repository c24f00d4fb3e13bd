"""File system sources: a distributed walk, changes between walks, image dimensions from headers. Folders must be mounted on all executors."""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.operators.scratch import saved

_FIELDS = [
    ("path", pa.string()), ("parent", pa.string()), ("is_dir", pa.bool_()), ("is_symlink", pa.bool_()), ("size", pa.int64()),
    ("modified_ns", pa.int64()), ("inode", pa.int64()), ("error", pa.bool_()), ("open", pa.bool_()),
]
_SCHEMA = "path string, parent string, is_dir boolean, is_symlink boolean, size long, modified_ns long, inode long, error boolean, open boolean"
#: Folders that a task lists in the first round, and how much more in each later one; what it leaves is dealt out anew.
FIRST_FOLDERS, MORE = 32, 16
_ROWS = 10_000

Reader = Callable[[int, int], bytes]


def _row(entry: os.DirEntry, parent: str) -> tuple:
    try:
        link = entry.is_symlink()
        folder = entry.is_dir(follow_symlinks=False)
        stat = entry.stat(follow_symlinks=False)
        return (entry.path, parent, folder, link, stat.st_size, max(0, stat.st_mtime_ns), stat.st_ino, False, False)
    except OSError:
        return (entry.path, parent, False, False, None, None, None, True, False)


def _below(folders: Iterator[str], root: str, most: int) -> Iterator[tuple]:
    """Entries of these folders and of those below, until ``most`` folders are listed; the rest come as open ones."""
    listed = 0
    for top in folders:
        stack = [top]
        while stack:
            folder = stack.pop()
            if listed >= most:
                yield (folder, None, True, False, None, None, None, False, True)
                continue
            listed += 1
            try:
                with os.scandir(folder) as entries:
                    for entry in entries:
                        row = _row(entry, folder)
                        yield row
                        if row[2]:
                            stack.append(entry.path)
            except OSError:
                if folder == root:  # an unreadable root fails the scan
                    raise
                yield (folder, None, True, False, None, None, None, True, False)


def _listed(root: str, most: int):
    def work(batches):
        rows = _below((x.as_py() for batch in batches for x in batch.column("path")), root, most)
        held: list[tuple] = []
        for row in rows:
            held.append(row)
            if len(held) == _ROWS:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    return work


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every entry below root, hidden ones and links too; links aren't followed. A folder that can't be listed has one more row, with error.

    Folders are listed by tasks, round after round: a task lists what it was dealt and
    what it finds below, up to a number of folders that grows with the rounds, and the
    folders that it leaves are dealt out to all tasks again. So a wide tree is spread after
    the first round, a deep one takes as many rounds as the logarithm of its depth, and the
    driver lists nothing. Each round's rows are a written table.
    """
    frontier, rounds, most, left = spark.createDataFrame([(root,)], "path string"), [], FIRST_FOLDERS, 1
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while left:
        rounds.append(saved(frontier.repartition(min(tasks, left)).mapInArrow(_listed(root, most), _SCHEMA)))
        frontier, most = rounds[-1].where("open").select("path"), most * MORE
        left = frontier.count()
    out = spark.createDataFrame([(root, None, True, False, None, None, None, False, False)], _SCHEMA)
    for found in rounds:
        out = out.unionByName(found.where("not open"))
    return out.drop("open")


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    return scan_tree(spark, root).where("not is_dir and not is_symlink")


def directories(tree: DataFrame) -> DataFrame:
    """Folders of a walk, each once: those it listed and those it could not."""
    return tree.where("is_dir").groupBy("path").agg(F.bool_or("error").alias("error"))


# --- changes

CHANGES = "path string, event_type string, from_path string, size long, modified_ns long"
_STATE = ["path", "size", "modified_ns", "inode"]


def changes(old: DataFrame, now: DataFrame, errors: int = 0) -> DataFrame:
    """What happened between two snapshots of files (path, size, modified_ns, inode): create, modify, remove, move.

    A file is modified if its size, its time or its inode is another one, whether the time is
    older or newer; a replaced file thus shows even if both size and time are equal. A
    removed and a created path with one inode, size and time are a move, each file at
    most once, in the order of paths. After a walk with errors nothing is removed or moved.
    """
    b = now.select(*[F.col(c).alias(f"_{c}") for c in _STATE])
    both = old.select(*_STATE).join(b, F.col("path") == F.col("_path"), "full_outer")
    differ = ~(F.col("size").eqNullSafe(F.col("_size")) & F.col("modified_ns").eqNullSafe(F.col("_modified_ns")) & F.col("inode").eqNullSafe(F.col("_inode")))
    kind = F.when(F.col("_path").isNull(), "remove").when(F.col("path").isNull(), "create").when(differ, "modify")
    pick = lambda c: F.when(F.col("_path").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    found = saved(both.select(*[pick(c) for c in _STATE], kind.alias("event_type")).where("event_type is not null"))
    none = F.lit(None).cast("string").alias("from_path")
    if errors:
        return found.where("event_type <> 'remove'").select("path", "event_type", none, "size", "modified_ns")
    same = ["inode", "size", "modified_ns"]
    numbered = found.withColumn("_k", F.row_number().over(Window.partitionBy(*same, "event_type").orderBy("path")))  # the links of one file
    gone = numbered.where("event_type = 'remove' and inode is not null").select(*same, "_k", F.col("path").alias("from_path"))
    moved = numbered.where("event_type = 'create'").join(gone, [*same, "_k"])
    plain = found.join(moved.select("path"), "path", "left_anti").join(moved.select(F.col("from_path").alias("path")), "path", "left_anti")
    out = plain.select("path", "event_type", none, "size", "modified_ns")
    return out.unionByName(moved.select("path", F.lit("move").alias("event_type"), "from_path", "size", "modified_ns"))


def watch(spark: SparkSession, root: str, folder: str, **trigger):
    """A stream that walks ``root`` batch after batch and writes ``changes`` between walks below ``folder``; ``change_stream`` reads them.

    Each batch keeps the snapshot of its walk as a table and compares it with that
    of the batch before; a batch that runs again after a failure overwrites its own
    tables and compares with the same one, so every change is written once. The first batch
    only takes the snapshot. Files that a walk with errors didn't see stay in the snapshot. A clock, not a listing, starts
    batches, so the driver knows nothing of the files.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def step(_: DataFrame, batch: int) -> None:
        walk = saved(scan_tree(spark, root))
        errors = walk.where("error").count()
        now = walk.where("not is_dir and not is_symlink and size is not null").select(*_STATE)
        before = f"{folder}/snapshots/{batch - 1}"
        if batch and fs.exists(jvm.org.apache.hadoop.fs.Path(before)):
            old = spark.read.parquet(before)
            changes(old, now, errors).withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{folder}/changes/{batch}")
            if errors:
                now = now.unionByName(old.join(now.select("path"), "path", "left_anti"))
        now.write.mode("overwrite").parquet(f"{folder}/snapshots/{batch}")
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/snapshots/{batch - 2}"), True)

    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    return clock.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger or {"processingTime": "500 milliseconds"}).start()


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The changes that ``watch`` writes, as a stream."""
    return spark.readStream.schema(f"{CHANGES}, batch long").option("recursiveFileLookup", "true").parquet(f"{folder}/changes")


# --- image headers


def dimensions(data: bytes) -> tuple[int, int] | None:
    """Width and height as shown, of the bytes of a PNG, GIF, BMP, ICO, WebP, JPEG or TIFF file."""
    return dimensions_of(lambda at, n: data[at : at + n])


def dimensions_of(get: Reader) -> tuple[int, int] | None:
    """The same from a function that reads n bytes at a place, wherever in the file the format keeps them."""
    try:
        head = get(0, 32)
        if head[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", head[16:24])
        if head[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", head[6:10])
        if head[:2] == b"BM":
            w, h = struct.unpack("<ii", head[18:26])
            return w, abs(h)
        if head[:4] == b"\0\0\1\0":
            count = struct.unpack("<H", head[4:6])[0]
            entries = get(6, 16 * count)
            best = [(entries[16 * k] or 256, entries[16 * k + 1] or 256) for k in range(count)]
            return max(best, key=lambda x: x[0] * x[1])
        if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            return _webp(head)
        if head[:2] == b"\xff\xd8":
            return _jpeg(get)
        if head[:4] in (b"II*\0", b"MM\0*"):
            tags = _tiff(get, 0)
            size = (tags[256], tags[257])
            return size[::-1] if tags.get(274, 1) >= 5 else size
    except (struct.error, IndexError, KeyError, ValueError):
        return None
    return None


def _webp(head: bytes):
    kind = head[12:16]
    if kind == b"VP8X":
        return int.from_bytes(head[24:27], "little") + 1, int.from_bytes(head[27:30], "little") + 1
    if kind == b"VP8L":
        bits = int.from_bytes(head[21:25], "little")
        return (bits & 0x3FFF) + 1, ((bits >> 14) & 0x3FFF) + 1
    w, h = struct.unpack("<HH", head[26:30])
    return w & 0x3FFF, h & 0x3FFF


def _tiff(get: Reader, base: int) -> dict[int, int]:
    """Tags of the first directory, which may lie anywhere behind the header, usually after the pixels."""
    order = "<" if get(base, 2) == b"II" else ">"
    at = base + struct.unpack(order + "I", get(base + 4, 4))[0]
    count = struct.unpack(order + "H", get(at, 2))[0]
    data, out = get(at + 2, 12 * count), {}
    for k in range(count):
        entry = data[12 * k : 12 * k + 12]
        tag, kind = struct.unpack(order + "HH", entry[:4])
        out[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entry[8:10] if kind == 3 else entry[8:12])[0]
    return out


def _jpeg(get: Reader):
    """From segment to segment, however long these are; bytes 0xFF may fill the gaps between them."""
    at, turned = 2, False
    while True:
        lead, mark = get(at, 2)
        if lead != 0xFF:
            return None
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0x01 or 0xD0 <= mark <= 0xD8:  # without a length
            at += 2
            continue
        size = struct.unpack(">H", get(at + 2, 2))[0]
        if size < 2:
            return None
        if mark == 0xE1 and get(at + 4, 6) == b"Exif\0\0":
            try:
                turned = _tiff(get, at + 10).get(274, 1) >= 5
            except (struct.error, IndexError):
                pass  # a broken directory says nothing about the turn
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", get(at + 5, 4))
            return (h, w) if turned else (w, h)
        at += 2 + size


def _header(path: str) -> tuple[int, int] | None:
    try:
        with open(path, "rb") as f:

            def get(at: int, n: int) -> bytes:
                f.seek(at)
                return f.read(n)

            return dimensions_of(get)
    except OSError:
        return None


def image_dims(files: DataFrame) -> DataFrame:
    """path, width, height of files by path, as the walk gives them; null where the header can't be read."""

    def read(batches):
        for batch in batches:
            found = [_header(x.as_py()) for x in batch.column("path")]
            dims = [pa.array([f and int(f[k]) for f in found], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *dims], ["path", "width", "height"])

    return files.select("path").mapInArrow(read, "path string, width int, height int")
