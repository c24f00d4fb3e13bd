"""The driver's tables in the shape of a catalog, in both dialects."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.scalars import cache_key, extension_lower
from strandloom.operators.scratch import folder
from strandloom.schema import FORMATS
from strandloom.sources import sink

EXTENSIONS = ("jpg", "JPEG", "png", "WEBP", "gif", "bmp", "tif", "TIFF", "ico", "txt", "heic")


def table(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def listing(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    ext = F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (F.col("doc_id") % 11 + 1).cast("int"))
    name = F.concat(F.lit("img"), F.col("doc_id").cast("string"), F.lit("."), ext)
    out = docs.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("/lib/"), "lang").alias("root"),
        F.concat("source", F.lit("/"), name).alias("relative_path"), name.alias("file_name"),
        (F.col("n_chars") * 1024 + F.col("doc_id")).alias("size"),
        (F.lit(1700000000000000000) + F.col("doc_id") * 1000003).alias("modified_ns"),
    )
    dims = lambda m: F.when(F.col("id") % 3 != 0, (F.col("id") % m + 1).cast("int"))
    return out.select(
        "id", "root", F.concat("root", F.lit("/"), "relative_path").alias("path"), "relative_path", "file_name", "size",
        "modified_ns", dims(4000).alias("width"), dims(3000).alias("height"),
        extension_lower(F.col("file_name")).alias("format"),
    )


def current(spark, d) -> DataFrame:
    return listing(spark, d).where(F.col("format").isin(*FORMATS))


def previous(spark, d) -> DataFrame:
    cur = current(spark, d)
    old = cur.where("id % 11 <> 4").withColumn("size", F.col("size") + F.when(F.col("id") % 5 == 0, 1).otherwise(0))
    name = F.concat(F.lit("img"), F.col("id").cast("string"), F.lit(".jpg"))
    gone = cur.where("id % 7 = 0").select(
        (F.col("id") + 10000000).alias("id"), "root", F.concat("root", F.lit("/gone/"), name).alias("path"),
        F.concat(F.lit("gone/"), name).alias("relative_path"), name.alias("file_name"), "size", "modified_ns", "width",
        "height", F.lit("jpg").alias("format"),
    )
    return old.unionByName(gone)


def file_tree(spark, d) -> str:
    """A tree with one small image for each page, in seven folders, an empty one, and a link; the images are written by tasks."""
    root = folder(spark).removeprefix("file://") + "/tree"
    k = F.col("page_id")
    number = lambda x: F.unhex(F.lpad(F.hex(x), 8, "0"))
    head = F.lit(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR")
    name = F.concat(F.lit("d"), (k % 7).cast("string"), F.lit("/f"), k.cast("string"), F.lit(".png"))
    rows = table(spark, d, "pages").select(name.alias("name"), F.concat(head, number(k % 50 + 1), number(k % 30 + 2)).alias("content"))
    sink.write_files(rows, root)
    os.makedirs(f"{root}/none")
    os.symlink(f"{root}/none", f"{root}/link")
    for name in (sink.STAGED, sink.COMMITS):
        shutil.rmtree(f"{root}/{name}")
    return root


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("thumbnail_key", cache_key(F.col("path"), F.col("size"), F.col("modified_ns")))


CTE = """
with listing as (
  select doc_id as id, '/lib/' || lang as root, '/lib/' || lang || '/' || source || '/' || file_name as path, source || '/' || file_name as relative_path, file_name,
    n_chars * 1024 + doc_id as size, 1700000000000000000 + doc_id * 1000003 as modified_ns,
    case when doc_id % 3 <> 0 then (doc_id % 4000 + 1)::int end as width, case when doc_id % 3 <> 0 then (doc_id % 3000 + 1)::int end as height,
    lower(ext) as format
  from (select *, 'img' || doc_id || '.' || ext as file_name from (select *, (['jpg','JPEG','png','WEBP','gif','bmp','tif','TIFF','ico','txt','heic'])[(doc_id % 11 + 1)::int] as ext from documents))),
cur as (select * from listing where format in ('jpg','jpeg','png','webp','gif','bmp','tif','tiff','ico')),
prev as (
  select id, root, path, relative_path, file_name, size + case when id % 5 = 0 then 1 else 0 end as size, modified_ns, width, height, format from cur where id % 11 <> 4
  union all
  select id + 10000000, root, root || '/gone/img' || id || '.jpg', 'gone/img' || id || '.jpg', 'img' || id || '.jpg', size, modified_ns, width, height, 'jpg' from cur where id % 7 = 0),
diff as (
  select coalesce(c.root, p.root) as root, coalesce(c.path, p.path) as path, coalesce(p.id, c.id) as id, coalesce(c.size, p.size) as size, coalesce(c.modified_ns, p.modified_ns) as modified_ns, coalesce(c.format, p.format) as format,
    case when c.path is null then 'removed' when p.path is null then 'inserted' when c.size = p.size and c.modified_ns = p.modified_ns and c.format = p.format then 'reused' else 'updated' end as status
  from cur c full outer join prev p on c.root = p.root and c.path = p.path),
placed as (select *, row_number() over (partition by root order by modified_ns desc, id) - 1 as pos from cur),
sel as (select doc_id as id from labels where quality = 1),
ev as (select event_id as seq, user_id % 20 as generation, case when event_type = 'signup' then 'started' when event_type = 'error' then 'remove' else 'upsert' end as kind, 'p' || (event_id % 50) as path, event_id * 3 as size from events),
req as (select row_number() over (order by conv_id, turn) as seq, conv_id % 5 as generation, turn as epoch, role || '-' || (conv_id % 7) as key, case role when 'user' then 'visible' when 'assistant' then 'prefetch' else 'preview' end as priority from conversations),
caches as (select vec_id::varchar || case when vec_id % 10 = 3 then '.tmp-1' else '.rgba' end as path, case when vec_id % 17 = 0 then null else (vec_id * 7919) % 1000 end as mtime, (coalesce(label, 0) + 1) * 1000003::bigint as size from embeddings),
dirs as (select distinct regexp_extract(url, '://([^/?#]+)', 1) as path from pages)
"""
