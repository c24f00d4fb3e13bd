"""The catalog's queries and their SQL in a second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import scalars as S
from strandloom.operators import caches, catalog, events, folders, transfers, views
from strandloom.operators.ordering import numbered
from strandloom.operators.scratch import folder
from strandloom.plans.fixtures import CTE, current, file_tree, keyed, listing, previous, table
from strandloom.schema import CACHE_MAGIC, QUEUE_CAPS, storage_locations
from strandloom.sources import files, sink
from strandloom.streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name, with its SQL after the fixture's tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql and sql.startswith(", recursive "):
            SQL[f.__name__] = CTE.replace("with ", "with recursive ", 1) + sql.replace(" recursive", "", 1)
        elif sql:
            SQL[f.__name__] = CTE + sql
        return f

    return add


def _diff(spark, d):
    return catalog.incremental_diff(current(spark, d), previous(spark, d))


def _placed(spark, d):
    return views.positions(current(spark, d))


def _selection(spark, d):
    return table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))


def _events(spark, d):
    kind = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "error", "remove").otherwise("upsert")
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 20).alias("generation"), kind.alias("kind"),
        F.concat(F.lit("p"), (F.col("event_id") % 50).cast("string")).alias("path"),
        (F.col("event_id") * 3).alias("size"),
    )


def _requests(spark, d):
    role = F.when(F.col("role") == "user", "visible").when(F.col("role") == "assistant", "prefetch").otherwise("preview")
    c = numbered(table(spark, d, "conversations"), [], [F.col("conv_id"), F.col("turn")], "_k")  # numbers of arrival
    key = F.concat("role", F.lit("-"), (F.col("conv_id") % 7).cast("string"))
    return c.select(
        (F.col("_k") + 1).alias("seq"), (F.col("conv_id") % 5).alias("generation"), F.col("turn").alias("epoch"),
        key.alias("key"), role.alias("priority"),
    )


def _caches(spark, d):
    e = table(spark, d, "embeddings")
    name = F.concat(F.col("vec_id").cast("string"), F.when(F.col("vec_id") % 10 == 3, ".tmp-1").otherwise(".rgba"))
    return e.select(
        name.alias("path"), F.when(F.col("vec_id") % 17 != 0, F.col("vec_id") * 7919 % 1000).alias("mtime"),
        ((F.coalesce("label", F.lit(0)) + 1) * F.lit(1000003).cast("long")).alias("size"),
    )


# --- scans, projections, scalars


@query("select id, root, path, relative_path, file_name, size, modified_ns, width, height, format from cur where root = '/lib/en'")
def catalog_load(spark, d) -> DataFrame:
    return current(spark, d).where("root = '/lib/en'").select(
        "id", "root", "path", "relative_path", "file_name", "size", "modified_ns", "width", "height", "format",
    )


@query("select id, format from listing where format in ('jpg','jpeg','png','webp','gif','bmp','tif','tiff','ico')")
def supported_filter(spark, d):
    return listing(spark, d).where(S.supported(F.col("file_name"))).select("id", "format")


@query("select id, path[len(root) + 2:] as relative, list_extract(string_split(path, '/'), -1) as name, 'img' || id as stem, format as ext, length(path) - length(replace(path, '/', '')) as depth from listing")
def path_parts(spark, d):
    p = F.col("path")
    return listing(spark, d).select(
        "id", S.relative_path(p, F.col("root")).alias("relative"), S.file_name(p).alias("name"),
        S.file_stem(S.file_name(p)).alias("stem"), S.extension_lower(S.file_name(p)).alias("ext"),
        S.path_depth(p).cast("long").alias("depth"),
    )


_LE8 = "unhex(substr(lpad(to_hex({x}),16,'0'),15,2)||substr(lpad(to_hex({x}),16,'0'),13,2)||substr(lpad(to_hex({x}),16,'0'),11,2)||substr(lpad(to_hex({x}),16,'0'),9,2)||substr(lpad(to_hex({x}),16,'0'),7,2)||substr(lpad(to_hex({x}),16,'0'),5,2)||substr(lpad(to_hex({x}),16,'0'),3,2)||substr(lpad(to_hex({x}),16,'0'),1,2))"
_KEY = f"sha256(encode(path) || {_LE8.format(x='size')} || {_LE8.format(x='modified_ns')} || encode('thumb-v2-256'))"


@query(f"select id, {_KEY} as thumbnail_key from cur")
def cache_key(spark, d):
    return keyed(current(spark, d)).select("id", "thumbnail_key")


@query(f"select id, {_KEY} || case when id % 2 = 0 then ':preview' else ':thumb' end as texture_key, {_KEY} || '.rgba' as cache_file from cur")
def texture_key(spark, d):
    return keyed(current(spark, d)).select(
        "id", S.texture_key(F.col("thumbnail_key"), F.col("id") % 2 == 0).alias("texture_key"),
        S.cache_file(F.col("thumbnail_key")).alias("cache_file"),
    )


_BYTES = "case when {x} >= 1073741824 then printf('%.2f GiB', {x} / 1073741824.0::double) when {x} >= 1048576 then printf('%.1f MiB', {x} / 1048576.0::double) when {x} >= 1024 then printf('%.1f KiB', {x} / 1024.0::double) else {x} || ' B' end"


@query(f"select id, {_BYTES.format(x='(size // (id % 7 + 1) // (case when id % 13 = 0 then 4096 else 1 end))')} as shown from cur")
def format_bytes(spark, d):
    return current(spark, d).select("id", S.format_bytes(F.expr("size div (id % 7 + 1) div (case when id % 13 = 0 then 4096 else 1 end)")).alias("shown"))


@query("select id, lower(file_name) as low, upper(format) as up from listing")
def case_fold(spark, d):
    return listing(spark, d).select("id", F.lower("file_name").alias("low"), F.upper("format").alias("up"))


@query(f"select id, file_name || chr(10) || coalesce(width::varchar, '?') || ' x ' || coalesce(height::varchar, '?') || chr(10) || ({_BYTES.format(x='size')}) || chr(10) || upper(format) as hover from cur")
def hover_text(spark, d):
    return current(spark, d).select("id", S.hover_text(F.col("file_name"), F.col("width"), F.col("height"), F.col("size"), F.col("format")).alias("hover"))


@query("select id, least(256.0::double / width, 256.0::double / height) as thumb, least(least(1600.0::double / width, 900.0::double / height), 1.0) as preview from cur where width is not null")
def fit_scale(spark, d):
    cur = current(spark, d).where("width is not null")
    return cur.select(
        "id", S.fit_scale(256, 256, F.col("width"), F.col("height"), False).alias("thumb"),
        S.fit_scale(1600, 900, F.col("width"), F.col("height"), True).alias("preview"),
    )


@query("select id, greatest(least(greatest(least(1.0::double * (1 + (id % 900)::double * 0.001), 12.0), 0.05) * (1 + (-(id % 1100))::double * 0.001), 12.0), 0.05)::double as zoom, (id % 4 + 1) % 4 as rotation from cur")
def zoom_clamp(spark, d):
    steps = F.array((F.col("id") % 900).cast("double"), (-(F.col("id") % 1100)).cast("double"))
    return current(spark, d).select("id", S.zoom(steps).alias("zoom"), S.rotate(F.col("id") % 4).alias("rotation"))


@query("select event_id, coalesce(greatest(case when event_id % 9 = 0 then null else event_id - 100 end, 0), 0)::bigint as ns from events")
def mtime_ns(spark, d):
    return table(spark, d, "events").select("event_id", S.mtime_ns(F.when(F.col("event_id") % 9 != 0, F.col("event_id") - 100)).alias("ns"))


@query("select id, lower(rtrim('C:\\Temp\\' || file_name || '\\', '\\/')) = lower(rtrim('c:\\temp\\' || upper(file_name) || case when id % 2 = 0 then '/' else 'x' end, '\\/')) as same from cur")
def same_path(spark, d):
    a = F.concat(F.lit("C:\\Temp\\"), "file_name", F.lit("\\"))
    b = F.concat(F.lit("c:\\temp\\"), F.upper("file_name"), F.when(F.col("id") % 2 == 0, "/").otherwise("x"))
    return current(spark, d).select("id", S.same_path(a, b).alias("same"))


@query("select id, printf('%.2f', (size // 10 * 10) / 1000.0::double) as elapsed, case id % 4 when 0 then 'Modified (newest)' when 1 then 'Name' when 2 then 'Size (largest)' else 'Path' end as label from cur")
def display_labels(spark, d):
    mode = F.element_at(F.array(*[F.lit(x) for x in ("modified", "natural", "size", "path")]), (F.col("id") % 4 + 1).cast("int"))
    return current(spark, d).select("id", S.format_seconds(F.expr("size div 10 * 10")).alias("elapsed"), S.sort_label(mode).alias("label"))


@query("select p_partkey, greatest(2, least(8, p_size - 1)) as threads from part")
def worker_count(spark, d):
    return table(spark, d, "part").select("p_partkey", S.decoder_threads(F.col("p_size")).alias("threads"))


@query("select distinct root, root || '/data/catalog' as catalog, root || '/data/cache/thumbnails' as thumbnails from listing")
def locations(spark, d):
    names = storage_locations("")
    return listing(spark, d).select("root").distinct().select("root", *[F.concat("root", F.lit(x)).alias(k) for k, x in names.items()])


# --- snapshot comparison and changes


@query("select * from diff")
def incremental_diff(spark, d):
    return _diff(spark, d)


@query("""select coalesce(c.root, p.root) as root, coalesce(c.path, p.path) as path, coalesce(p.id, c.id) as id, case when c.size is not null then c.size else p.size end as size,
  case when c.path is null then 'removed' when c.size is null then case when p.path is null then 'skipped' else 'kept' end
    when p.path is null then 'inserted' when c.size = p.size and c.modified_ns = p.modified_ns and c.format = p.format then 'reused' else 'updated' end as status
  from (select * replace (case when id % 13 = 0 then null else size end as size) from cur) c full outer join prev p on c.root = p.root and c.path = p.path""")
def unreadable_diff(spark, d):
    walk = current(spark, d).withColumn("size", F.when(F.col("id") % 13 != 0, F.col("size")))
    return catalog.incremental_diff(walk, previous(spark, d)).select("root", "path", "id", "size", "status")


_SYNC = """select root, path, coalesce(pid, top + row_number() over (partition by pid is null order by root, path))::bigint as id, size, modified_ns, width, height from (
  select c.root, c.path, p.id as pid, coalesce(c.size, p.size) as size, coalesce(c.modified_ns, p.modified_ns) as modified_ns, (select max(id) from prev) as top,
    case when c.size is null or c.size = p.size and c.modified_ns = p.modified_ns and c.format = p.format then p.width end as width,
    case when c.size is null or c.size = p.size and c.modified_ns = p.modified_ns and c.format = p.format then p.height end as height
  from (select * replace (case when id % 13 = 0 then null else size end as size) from listing where format in ('jpg','jpeg','png','webp','gif','bmp','tif','tiff','ico')) c
  left join prev p on c.root = p.root and c.path = p.path where c.size is not null or p.id is not null)"""


def _scan(spark, d, errors: bool):
    walk = keyed(listing(spark, d)).withColumn("size", F.when(F.col("id") % 13 != 0, F.col("size"))).drop("id", "width", "height")
    walk = walk.withColumn("error", F.lit(False))
    if errors:
        walk = walk.unionByName(table(spark, d, "pages").where("page_id % 50 = 0").select(F.col("url").alias("path"), F.lit(True).alias("error")), allowMissingColumns=True)
    return catalog.scan(keyed(previous(spark, d)), walk)


@query(_SYNC)
def catalog_sync(spark, d):
    """A whole scan: listing, filter, comparison, merge, removal of what was not seen."""
    return _scan(spark, d, False)[0].select("root", "path", "id", "size", "modified_ns", "width", "height")


@query(_SYNC + """ union all select root, path, id, size, modified_ns, width, height from prev p
  where not exists (select 1 from cur c where c.root = p.root and c.path = p.path) and exists (select 1 from pages where page_id % 50 = 0)""")
def catalog_sync_errors(spark, d):
    """The same scan where some folders couldn't be listed: nothing is removed."""
    return _scan(spark, d, True)[0].select("root", "path", "id", "size", "modified_ns", "width", "height")


_REPORT_OF_SCAN = """, met as (
  select c.path as seen, p.path as known, c.size as size, c.size = p.size and c.modified_ns = p.modified_ns and c.format = p.format as same
  from (select * replace (case when id % 13 = 0 then null else size end as size) from cur) c full outer join prev p on c.root = p.root and c.path = p.path),
counted as (
  select (select count(*) from listing) as visited, count(seen) as supported, count(*) filter (size is not null and same) as reused,
    count(*) filter (size is not null and known is null) as inserted, count(*) filter (size is not null and known is not null and not same) as updated,
    count(*) filter (seen is null) as unseen, {errors} as errors from met)
select visited, supported, reused, inserted, updated, case when errors = 0 then unseen else 0 end as removed, errors, supported + case when errors = 0 then 0 else unseen end as total from counted"""


def _report_of_scan(spark, d, errors):
    stats = _scan(spark, d, errors)[1]
    del stats["elapsed_ms"]  # differs from run to run
    return spark.createDataFrame([stats], ", ".join(f"{k} long" for k in stats))


@query(_REPORT_OF_SCAN.format(errors="0::bigint"))
def scan_report(spark, d):
    return _report_of_scan(spark, d, False)


@query(_REPORT_OF_SCAN.format(errors="(select count(*) from pages where page_id % 50 = 0)"))
def scan_report_errors(spark, d):
    return _report_of_scan(spark, d, True)


@query("select id, path from prev where (root, path) not in (select (root, path) from cur)")
def removed_paths(spark, d):
    return catalog.removed_paths(current(spark, d), previous(spark, d)).select("id", "path")


@query("select id, path from prev where (root, path) not in (select (root, path) from cur) and not exists (select 1 from events where event_type = 'error')")
def removed_paths_guarded(spark, d):
    errors = table(spark, d, "events").where("event_type = 'error'")
    return catalog.removed_paths(current(spark, d), previous(spark, d), errors).select("id", "path")


@query("select count(*) filter (status <> 'removed') as supported, count(*) filter (status = 'reused') as reused, count(*) filter (status = 'inserted') as inserted, count(*) filter (status = 'updated') as updated, count(*) filter (status = 'removed') as removed from diff")
def scan_stats(spark, d):
    return catalog.scan_stats(_diff(spark, d))


@query("select count(*) as total from diff")
def scan_total(spark, d):
    return catalog.scan_total(_diff(spark, d), errors=1)


@query("select root, path, case when rn <= 128 then 0 else 1 + (rn - 129) // 512 end::bigint as batch from (select *, row_number() over (partition by root order by path) as rn from diff where status in ('inserted', 'updated'))")
def batch_assign(spark, d):
    return catalog.batch_assign(_diff(spark, d)).select("root", "path", "batch")


@query("""select root, path, coalesce(pid, top + row_number() over (partition by pid is null order by root, path))::bigint as id, size, width, height from (
  select coalesce(c.root, p.root) as root, coalesce(c.path, p.path) as path, p.id as pid, coalesce(c.size, p.size) as size, case when c.path is null then p.width end as width, case when c.path is null then p.height end as height, (select max(id) from prev) as top
  from (select * from cur where id % 2 = 0) c full outer join prev p on c.root = p.root and c.path = p.path)""")
def catalog_upsert(spark, d):
    out = catalog.upsert(keyed(previous(spark, d)), keyed(current(spark, d).where("id % 2 = 0")))
    return out.select("root", "path", "id", "size", "width", "height")


@query("select id, path from cur where id not in (select id from sel)")
def catalog_delete(spark, d):
    return views_delete(current(spark, d), _selection(spark, d)).select("id", "path")


def views_delete(rows, ids):
    return events.apply_removes(rows, ids)


_UPDATES = "(select id, path, modified_ns + case when id % 4 = 0 then 1 else 0 end as modified_ns, (id % 640 + 1)::int as width, (id % 480 + 1)::int as height from cur where id % 3 = 0)"


def _updates(spark, d):
    cur = current(spark, d).where("id % 3 = 0")
    late = cur.select(
        "id", "path", F.expr("modified_ns + case when id % 4 = 0 then 1 else 0 end").alias("modified_ns"),
        F.expr("cast(id % 640 + 1 as int)").alias("width"), F.expr("cast(id % 480 + 1 as int)").alias("height"),
        F.lit(2).alias("seq"),
    )
    early = late.withColumn("width", F.lit(7)).withColumn("seq", F.lit(1))
    return early.unionByName(late)


@query(f"select c.id, case when u.id is null then c.width else u.width end as width, case when u.id is null then c.height else u.height end as height from cur c left join {_UPDATES} u using (id, path, modified_ns)")
def metadata_update_guarded(spark, d):
    return catalog.update_metadata(current(spark, d), _updates(spark, d)).select("id", "width", "height")


@query("select id, w as width, h as height from (select *, (id % 5)::int as w, (id % 3000 + 1)::int as h from cur) where w > 0 and (width is distinct from w or height is distinct from h)")
def metadata_changed(spark, d):
    res = current(spark, d).select(
        "id", "path", "modified_ns", F.expr("cast(id % 5 as int)").alias("width"),
        F.expr("cast(id % 3000 + 1 as int)").alias("height"),
    )
    return catalog.changed_metadata(current(spark, d), res).select("id", "width", "height")


@query("""select id, root, path, size, width from (select *, row_number() over (partition by root, path order by id desc) as k from
  (select id, root, path, size, width from cur union all select id + 50000000, case when id % 2 = 0 then root else '/lib/two' end, path, size + 1, width from cur where id % 3 = 0)) where k = 1""")
def schema_migrate(spark, d):
    """Rows of schema 1, where one path may stand under two roots, some under the same root twice."""
    more = current(spark, d).where("id % 3 = 0").withColumn("root", F.when(F.col("id") % 2 == 0, F.col("root")).otherwise("/lib/two"))
    more = more.withColumn("id", F.col("id") + 50_000_000).withColumn("size", F.col("size") + 1)
    return catalog.migrate(current(spark, d).unionByName(more)).select("id", "root", "path", "size", "width")


@query("select root, path, count(*) as n from (select root, path from cur union all select root, path from prev) group by root, path having count(*) > 1")
def key_violations(spark, d):
    return catalog.key_violations(current(spark, d).select("root", "path").unionByName(previous(spark, d).select("root", "path")))


# --- views


def _sorted(mode):
    return lambda spark, d: views.positions(current(spark, d), mode).select("root", "id", "pos")


_NATURAL = "list_transform(regexp_extract_all(lower(file_name), '([0-9]+|[^0-9]+)'), lambda x: case when regexp_full_match(x, '[0-9]+') then lpad(length(ltrim(x, '0'))::varchar, 4, '0') || ltrim(x, '0') else x end)"
for _mode, _order in {"modified": "modified_ns desc", "natural": _NATURAL, "size": "size desc", "path": "lower(relative_path)"}.items():
    QUERIES[f"sort_{_mode}"] = _sorted(_mode)
    SQL[f"sort_{_mode}"] = CTE + f"select root, id, row_number() over (partition by root order by {_order}, id) - 1 as pos from cur"


@query("select root, id, pos from placed")
def positions(spark, d):
    return _placed(spark, d).select("root", "id", "pos")


@query("select root, id, pos, lag(id) over w as prev_id, lead(id) over w as next_id, (pos + 1) || ' / ' || count(*) over (partition by root) as label from placed window w as (partition by root order by pos)")
def neighbours(spark, d):
    return views.neighbours(_placed(spark, d))


@query("select root, id, pos from placed where abs(pos - 7) <= 1")
def neighbour_window(spark, d):
    return _placed(spark, d).where("abs(pos - 7) <= 1").select("root", "id", "pos")


@query("select root, id, pos, pos // 6 as row, pos % 6 as col, ((count(*) over (partition by root) + 5) // 6)::bigint as rows from placed")
def grid_layout(spark, d):
    return views.grid(_placed(spark, d), 1200, 160)


@query("select root, id, pos, case when pos >= 20 and pos < 50 then 'visible' else 'prefetch' end as tier from placed where pos >= 0 and pos < 80")
def viewport_tiers(spark, d):
    return views.tiers(_placed(spark, d), 20, 50)


@query("select id, root, pos, size from placed where id in (select id from sel)")
def selection_records(spark, d):
    return views.selected(_placed(spark, d), _selection(spark, d)).select("id", "root", "pos", "size")


@query("select (select count(distinct id) from sel) as n_selected, coalesce(sum(size), 0)::bigint as total_size from cur where id in (select id from sel)")
def selection_summary(spark, d):
    return views.selection_summary(current(spark, d), _selection(spark, d))


@query("select user_id as id from (select user_id, arg_max(event_type <> 'error', event_id) as checked from events group by user_id) where checked")
def selection_toggle(spark, d):
    return views.toggled(table(spark, d, "events").select(
        F.col("user_id").alias("id"), (F.col("event_type") != "error").alias("checked"), F.col("event_id").alias("seq"),
    ))


@query("select s.id, p.pos from sel s left join placed p on s.id = p.id")
def reanchor(spark, d):
    return views.reanchor(_placed(spark, d), _selection(spark, d))


@query("select root, rn, id, more from (select root, id, row_number() over (partition by root order by pos) as rn, greatest(count(*) over (partition by root) - 8, 0)::bigint as more from placed where id in (select id from sel)) where rn <= 8")
def top8_selected(spark, d):
    return views.first_eight(views.selected(_placed(spark, d), _selection(spark, d)))


@query("select distinct id from cur")
def select_all(spark, d):
    return views.select_all(current(spark, d))


@query(f"select id from cur where id not in (select id from cur where id % 6 = 0)")
def without_failed(spark, d):
    """Textures to decode, without those whose key failed."""
    wanted = keyed(current(spark, d)).select("id", S.texture_key(F.col("thumbnail_key"), F.lit(False)).alias("texture_key"))
    return views.without_failed(wanted, wanted.where("id % 6 = 0")).select("id")


@query("select path from placed where id in (select id from sel)")
def selected_paths(spark, d):
    return views.selected(_placed(spark, d), _selection(spark, d)).select("path")


# --- transfers


def _parts(spark, d):
    return table(spark, d, "part")


@query("select p_partkey, (lower(p_name) in (select lower(p_name) from part where p_partkey % 97 = 0)) as dest_exists, count(*) over (partition by lower(p_name)) as twins from part where p_partkey % 2 = 0")
def transfer_conflicts(spark, d):
    sel = _parts(spark, d).where("p_partkey % 2 = 0").select("p_partkey", F.col("p_name").alias("file_name"))
    there = _parts(spark, d).where("p_partkey % 97 = 0").select(F.col("p_name").alias("name"))
    return transfers.conflicts(sel, there).select("p_partkey", "dest_exists", "twins")


@query("select id, case when id % 4 = 0 then 'skip' else 'auto_rename' end as policy from cur")
def policy_resolve(spark, d):
    over = current(spark, d).where("id % 4 = 0").select("path", F.lit("skip").alias("policy"))
    return transfers.policies(current(spark, d), over, "auto_rename").select("id", "policy")


# names in a folder: of every seventh part the name itself, of every eleventh " (1)" and " (3)" of it
_THERE = """there as (select distinct p_name || '.jpg' as name from part where p_partkey % 7 = 0
  union select distinct p_name || ' (1).jpg' from part where p_partkey % 11 = 0 union select distinct p_name || ' (3).jpg' from part where p_partkey % 11 = 0)"""


def _there(spark, d):
    p = _parts(spark, d)
    of = lambda k, end: p.where(F.col("p_partkey") % k == 0).select(F.concat("p_name", F.lit(end)).alias("name"))
    return of(7, ".jpg").union(of(11, " (1).jpg")).union(of(11, " (3).jpg")).distinct()


# the free names of a stem in order: itself, then (1), (2), ...; the items of the stem take them in turn
_RENAMED = """renamed as (select i.seq, i.file_name, i.k, (list_filter([i.stem || '.jpg'] || list_transform(range(1, i.n + 4), lambda x: i.stem || ' (' || x || ').jpg'),
    lambda x: not list_contains(i.taken, lower(x))))[i.k] as target
  from (select *, row_number() over (partition by lower(file_name) order by seq) as k, count(*) over (partition by lower(file_name)) as n, file_name[:-5] as stem,
    coalesce((select list(lower(name)) from there where starts_with(lower(name), lower(file_name[:-5]))), []) as taken from items) i)"""


@query(f""", {_THERE}, items as (select p_partkey as seq, p_name || '.jpg' as file_name from part), {_RENAMED}
select seq, target from renamed""")
def auto_rename(spark, d):
    items = _parts(spark, d).select(F.col("p_partkey").alias("seq"), F.concat("p_name", F.lit(".jpg")).alias("file_name"), F.lit("auto_rename").alias("policy"))
    return transfers.auto_rename(items, _there(spark, d)).select("seq", "target")


def _plan_items(spark, d):
    name = F.concat("p_name", F.lit(".jpg"))
    action = F.element_at(F.array(*[F.lit(x) for x in ("copy", "move", "recycle_delete")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    path = F.concat(F.when(F.col("p_partkey") % 5 == 0, "/dest/").otherwise("/src/"), name)
    return _parts(spark, d).select(
        F.col("p_partkey").alias("seq"), name.alias("file_name"), F.lit("auto_rename").alias("policy"),
        path.alias("path"), action.alias("action"), (F.col("p_partkey") % 10 != 0).alias("source_exists"),
    )


@query(f""", {_THERE}, every as (select p_partkey as seq, p_name || '.jpg' as file_name, case when p_partkey % 5 = 0 then '/dest/' else '/src/' end || p_name || '.jpg' as path,
  ['copy', 'move', 'recycle_delete'][(p_partkey % 3 + 1)::int] as action, p_partkey % 10 <> 0 as source_exists from part),
items as (select * from every where source_exists and action <> 'recycle_delete'), {_RENAMED}
select e.seq, e.path, e.action, '/dest/' || r.target as target_path,
  case when not source_exists then 'skipped_missing' when action = 'move' and lower(path) = lower('/dest/' || r.target) then 'skipped_same' else 'planned' end as status
from every e left join renamed r on e.seq = r.seq""")
def op_plan(spark, d):
    return transfers.plan(_plan_items(spark, d), _there(spark, d), "/dest")


@query("select id, case when id % 7 = 0 or id % 3 = 0 and id % 2 = 0 then 'failed' else 'succeeded' end as status from cur")
def permanent_delete(spark, d):
    items = current(spark, d).select("id", "path", (F.col("id") % 3 == 0).alias("is_dir"), (F.col("id") % 7 != 0).alias("source_exists"))
    entries = current(spark, d).where("id % 2 = 0").select(F.col("path").alias("parent"))
    return transfers.permanent_delete(items, entries).select("id", "status")


def _report(spark, d, cancelled=False):
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.element_at(F.array(*[F.lit(x) for x in ("copy", "move", "recycle_delete", "permanent_delete")]), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("action"),
        (F.col("o_custkey") % 2 == 0).alias("source_exists"), (F.col("o_custkey") % 3 == 0).alias("target_exists"),
    )
    return transfers.verify(rows, cancelled=cancelled)


_REPORT = "(select o_orderkey as seq, ['copy','move','recycle_delete','permanent_delete'][(o_orderkey % 4 + 1)::int] as action, case when case o_orderkey % 4 when 0 then o_custkey % 3 = 0 when 1 then o_custkey % 2 <> 0 and o_custkey % 3 = 0 else o_custkey % 2 <> 0 end then 'succeeded' else 'failed' end as status from orders)"


@query(f"select * from {_REPORT}")
def op_verify(spark, d):
    return _report(spark, d).select("seq", "action", "status")


@query(f"select count(*) filter (status = 'succeeded') as succeeded, 0::bigint as skipped, count(*) filter (status = 'failed') as failed from {_REPORT}")
def op_summary(spark, d):
    return transfers.summary(_report(spark, d))


@query(f"select count(*) filter (status = 'succeeded') as succeeded, count(*) filter (status = 'failed') as skipped, 0::bigint as failed from {_REPORT}")
def op_summary_cancelled(spark, d):
    """After a cancelled request what wasn't done is skipped, not failed."""
    return transfers.summary(_report(spark, d, cancelled=True))


@query(f"select id, path from cur where id not in (select seq from {_REPORT} where status = 'succeeded' and action <> 'copy')")
def op_apply(spark, d):
    rep = _report(spark, d).join(current(spark, d).select(F.col("id").alias("seq"), "path"), "seq")
    return transfers.apply_report(current(spark, d), rep).select("id", "path")


# --- folders


def _tree(spark, d):
    url = table(spark, d, "pages").select(F.split(F.regexp_extract("url", r"://([^?#]+)", 1), "/").alias("p"))
    deep = url.select(
        F.concat(F.lit("/w/"), F.col("p")[0]).alias("a"),
        F.concat(F.lit("/w/"), F.col("p")[0], F.lit("/"), F.col("p")[1]).alias("b"), F.col("p")[2].alias("leaf"),
    )
    dirs = deep.select("a").union(deep.select("b")).union(spark.range(1).select(F.lit("/w"))).distinct().select(F.col("a").alias("path"), F.lit(False).alias("error"))
    entries = deep.select(F.lit("/w").alias("parent")).union(deep.select("a")).union(deep.where("pmod(length(leaf), 3) <> 0").select("b")).distinct()
    return dirs, entries


_TREE = """, deep as (select '/w/' || p[1] as a, '/w/' || p[1] || '/' || p[2] as b, p[3] as leaf from (select string_split(regexp_extract(url, '://([^?#]+)', 1), '/') as p from pages)),
tree as (select a as path from deep union select b from deep union select '/w'),
entries as (select '/w' as parent union select a from deep union select b from deep where length(leaf) % 3 <> 0)
"""


@query(_TREE + "select path, path[4:] as relative_path, lower(path[4:]) as sort_key from tree where path <> '/w' and path not in (select parent from entries)")
def empty_folders(spark, d):
    return folders.empty_folders(*_tree(spark, d), "/w")


@query(_TREE + """select path, path[4:] as relative_path from tree where path <> '/w' and path not in (select parent from entries)
  and length(path) % 4 <> 1 and length(path) % 5 <> 2""")
def empty_reverify(spark, d):
    """Since the folders were found empty, some got a file, some went, and some can't be read."""
    dirs, entries = _tree(spark, d)
    found = folders.empty_folders(dirs, entries, "/w")
    later = entries.union(dirs.where("length(path) % 4 = 1").select("path"))
    still = dirs.where("length(path) % 5 <> 2 or length(path) % 2 = 0").withColumn("error", F.expr("length(path) % 5 = 2"))
    return folders.reverify(found, still, later, "/w").select("path", "relative_path")


@query(_TREE + "select count(*) as visited, 0::bigint as errors, count(*) filter (path <> '/w' and path not in (select parent from entries)) as found from tree")
def empty_stats(spark, d):
    dirs, entries = _tree(spark, d)
    return folders.stats(dirs, folders.empty_folders(dirs, entries, "/w"))


@query(_TREE + """select count(*) as visited, count(*) filter (length(path) % 5 = 2) as errors,
  count(*) filter (path <> '/w' and length(path) % 5 <> 2 and path not in (select parent from entries)) as found from tree""")
def empty_stats_errors(spark, d):
    """The same where some folders can't be read, which are not found empty."""
    dirs, entries = _tree(spark, d)
    dirs = dirs.withColumn("error", F.expr("length(path) % 5 = 2"))
    return folders.stats(dirs, folders.empty_folders(dirs, entries, "/w"))


@query(_TREE + "select path, (length(path) - length(replace(path, '/', '')))::bigint as depth, row_number() over (order by length(path) - length(replace(path, '/', '')) desc, path) as rank from tree")
def depth_order(spark, d):
    out = numbered(folders.depth_order(_tree(spark, d)[0].select("path")), [], [-F.col("depth"), F.col("path")], "rank")
    return out.withColumn("rank", F.col("rank") + 1)


# --- caches


@query("select count(*) filter (path like '%.tmp-%') as leftovers, count(*) filter (path not like '%.tmp-%') as n_files, coalesce(sum(size) filter (path not like '%.tmp-%'), 0)::bigint as bytes from caches")
def cache_inventory(spark, d):
    return caches.inventory(_caches(spark, d).withColumnRenamed("path", "name"))


@query("select path, size from (select *, sum(size) over () as total, coalesce(sum(size) over (order by mtime nulls first, path rows between unbounded preceding and 1 preceding), 0) as before from caches) where total > 200000000 and total - before > 100000000")
def cache_eviction(spark, d):
    return caches.eviction(_caches(spark, d), 200_000_000, 100_000_000).select("path", "size")


@query("select path, size from (select *, coalesce(sum(size) over (order by mtime desc nulls last, path rows between unbounded preceding and 1 preceding), 0) as before from caches) where before + size <= 268435456")
def lru_eviction(spark, d):
    return caches.lru(_caches(spark, d).withColumnRenamed("mtime", "last_used"), 268435456).select("path", "size")


@query("select path from caches where mtime is not null order by mtime, path limit 1")
def lru_victim(spark, d):
    return caches.lru_victim(_caches(spark, d).where("mtime is not null").withColumnRenamed("mtime", "last_used"))


@query("select c.path, c.size - coalesce(case when mtime % 2 = 0 then 500 end, 0) as delta from caches c")
def cache_delta(spark, d):
    c = _caches(spark, d)
    return caches.write_delta(c.where("mtime % 2 = 0").select("path", F.lit(500).cast("long").alias("size")), c)


@query("select vec_id::varchar as path, vec_id % 5 <> 0 and vec_id % 3 <> 0 as valid, case when vec_id % 5 <> 0 and vec_id % 3 <> 0 then 4000::bigint end as source_width, case when vec_id % 5 <> 0 and vec_id % 3 <> 0 then 3000::bigint end as source_height, case when vec_id % 5 <> 0 and vec_id % 3 <> 0 then vec_id % 3 end as width, case when vec_id % 5 <> 0 and vec_id % 3 <> 0 then 1::bigint end as height from embeddings")
def cache_header_decode(spark, d):
    four = lambda x: F.substring(S.le8(x), 1, 4)
    v = F.col("vec_id")
    magic = F.when(v % 5 == 0, F.lit(b"RIPTHM1\0")).otherwise(F.lit(CACHE_MAGIC.encode()))
    body = F.unhex(F.repeat(F.lit("01020304"), (v % 3).cast("int")))
    content = F.concat(magic, four(F.lit(4000)), four(F.lit(3000)), four(v % 3), four(F.lit(1)), body)
    return caches.decode_header(table(spark, d, "embeddings").select(v.cast("string").alias("path"), content.alias("content")))


@query("""select id, case when id % 5 = 0 then null else '52495054484D3200' || 'A00F0000' || 'B80B0000' || case id % 3 when 0 then '01' when 1 then '02' else '03' end || '000000' || '01000000'
  || repeat('01020304', (id % 3 + 1)::int) end as content from cur where id % 4 <> 1""")
def cache_write(spark, d):
    """Entries of images that didn't change since, as they go to the cache; every fifth has a pixel too many."""
    cur = current(spark, d)
    seen = cur.withColumn("modified_ns", F.col("modified_ns") + F.when(F.col("id") % 4 == 1, 1).otherwise(0))
    dims = {"source_width": F.lit(4000), "source_height": F.lit(3000), "width": F.col("id") % 3 + 1, "height": F.lit(1)}
    pixels = F.unhex(F.repeat(F.lit("01020304"), (F.col("id") % 3 + F.when(F.col("id") % 5 == 0, 2).otherwise(1)).cast("int")))
    out = caches.encode(caches.still_fresh(seen.withColumns(dims | {"pixels": pixels}), cur))
    return out.select("id", F.hex("content").alias("content"))


# --- events


@query("select seq, path from ev where generation = (select arg_max(generation, seq) from ev where kind = 'started')")
def generation_filter(spark, d):
    return events.current_generation(_events(spark, d)).select("seq", "path")


@query("select seq from ev where generation = 3 and seq % 7 = 2 and kind = 'upsert'")
def sort_accept(spark, d):
    res = _events(spark, d).select("seq", "generation", (F.col("seq") % 7).alias("revision"), F.col("kind").alias("mode"))
    state = spark.range(1).select(F.lit(3).cast("long").alias("generation"), F.lit(2).cast("long").alias("revision"), F.lit("upsert").alias("mode"))
    return events.accepted_sorts(res, state).select("seq")


@query("select generation, max(seq) as seq, arg_max(path, seq) as path from ev group by generation")
def latest_wins(spark, d):
    return events.latest(_events(spark, d).select("generation", "seq", "path"), "generation")


@query("""select root, path, size, pos from (
  select coalesce(p.root, u.root) as root, coalesce(p.path, u.path) as path, coalesce(u.size, p.size) as size,
    coalesce(p.pos, (select count(*) from placed q where q.root = u.root and q.id % 3 <> 0) + row_number() over (partition by u.root, p.pos is null order by u.first) - 1)::bigint as pos
  from (select root, path, size, row_number() over (partition by root order by pos) - 1 as pos from placed where id % 3 <> 0) p
  full outer join (select root, path, size + 5 as size, id as first from cur where id % 2 = 0) u on p.root = u.root and p.path = u.path)""")
def apply_upserts(spark, d):
    rec = views.positions(current(spark, d).where("id % 3 <> 0")).select("root", "path", "size", "pos")
    ev = current(spark, d).where("id % 2 = 0").select("root", "path", (F.col("size") + 5).alias("size"), F.col("id").alias("seq"))
    first = ev.withColumn("size", F.lit(1).cast("long")).withColumn("seq", F.col("seq"))
    return events.apply_upserts(rec, first.withColumn("seq", F.col("seq") * 2).unionByName(ev.withColumn("seq", F.col("seq") * 2 + 1)))


@query("select id from cur where id not in (select id from sel)")
def apply_removes(spark, d):
    return events.apply_removes(current(spark, d), _selection(spark, d)).select("id")


@query("""select path, size from (
  select coalesce(r.path, e.path) as path, coalesce(e.size, r.size) as size, e.kind
  from (select distinct 'p' || (event_id % 40) as path, -1::bigint as size from events) r full outer join
  (select path, arg_max(kind, seq) as kind, arg_max(size, seq) as size from ev where generation = (select arg_max(generation, seq) from ev where kind = 'started') and kind in ('upsert', 'remove') group by path) e on r.path = e.path)
  where kind is null or kind = 'upsert'""")
def event_fold(spark, d):
    rec = table(spark, d, "events").select(F.concat(F.lit("p"), (F.col("event_id") % 40).cast("string")).alias("path"), F.lit(-1).cast("long").alias("size")).distinct()
    return events.fold(rec, _events(spark, d))


@query("select generation, case when priority = 'prefetch' then epoch else 0 end as epoch, key, priority, min(seq) as seq from req group by all")
def request_dedup(spark, d):
    return events.dedup_requests(_requests(spark, d))


@query("select seq from req r where priority <> 'prefetch' or epoch = (select max(epoch) from req q where q.generation = r.generation)")
def prefetch_epoch(spark, d):
    return events.valid_epochs(_requests(spark, d)).select("seq")


@query("select seq, priority from (select *, row_number() over (partition by priority order by seq) as rn from req) where rn <= case priority when 'preview' then 8 else 128 end")
def queue_cap(spark, d):
    return events.queue_caps(_requests(spark, d), QUEUE_CAPS).select("seq", "priority")


@query("select seq, priority from req order by case priority when 'preview' then 0 when 'visible' then 1 else 2 end, seq limit 32")
def priority_topk(spark, d):
    return events.next_requests(_requests(spark, d), 32).select("seq", "priority")


@query("select event_id, user_id from events where event_type <> 'view'")
def change_filter(spark, d):
    return streams.changes(table(spark, d, "events")).select("event_id", "user_id")


@query("""select user_id, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from (
  select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from (
    select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as fresh from events where event_type <> 'view'))
  group by user_id, session""")
def debounce_sessions(spark, d):
    return events.debounce(streams.changes(table(spark, d, "events")))


_BURSTS = """select user_id, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from (
  select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from (
    select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as fresh from events where event_type <> 'view'))
  group by user_id, session"""


@query(f"""select b.user_id, b.first_ts, coalesce(w.busy_until, last_ts + interval 6 hour) as fire_ts from ({_BURSTS}) b
  left join (select o_custkey as user_id, timestamp '2024-01-05' + interval 1 hour * (o_custkey % 400) as busy_from, timestamp '2024-01-06' + interval 1 hour * (o_custkey % 400) as busy_until
    from (select distinct o_custkey from orders)) w on b.user_id = w.user_id and last_ts + interval 6 hour >= busy_from and last_ts + interval 6 hour < busy_until""")
def debounce_busy(spark, d):
    who = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id")).distinct()
    begin = F.expr("timestamp_ntz'2024-01-05 00:00:00' + make_dt_interval(0, cast(user_id % 400 as int))").cast("timestamp")
    kind = table(spark, d, "events").schema["ts"].dataType
    busy = who.withColumn("busy_from", begin.cast(kind)).withColumn("busy_until", (F.col("busy_from") + F.expr("interval 24 hours")).cast(kind))
    bursts = events.debounce(streams.changes(table(spark, d, "events")))
    return events.fire_times(bursts, busy).select("user_id", "first_ts", "fire_ts")


@query(""", recursive shown as (
  select e.event_id, e.user_id, e.ts from (select *, row_number() over (partition by user_id order by ts, event_id) as k from events) e where k = 1
  union all
  select n.event_id, n.user_id, n.ts from (
    select e.event_id, e.user_id, e.ts, row_number() over (partition by e.user_id order by e.ts, e.event_id) as k
    from shown s join events e on e.user_id = s.user_id and e.ts >= s.ts + interval 6 hour) n where k = 1)
select event_id, user_id, ts from shown""")
def throttle(spark, d):
    return streams.throttle(table(spark, d, "events"))


# --- files: a small tree, written under the session's folder, whose names come from the pages


@query("select 'f' || page_id || '.png' as name, 24::bigint as size, false as error from pages")
def scan_files(spark, d):
    return files.scan_files(spark, file_tree(spark, d)).select(S.file_name(F.col("path")).alias("name"), "size", "error")


@query("select distinct 'd' || page_id % 7 as name, false as error from pages union select 'tree', false union select 'none', false")
def dir_scan(spark, d):
    return files.directories(files.scan_tree(spark, file_tree(spark, d))).select(S.file_name(F.col("path")).alias("name"), "error")


@query("select 'f' || page_id || '.png' as name, (page_id % 50 + 1)::int as width, (page_id % 30 + 2)::int as height from pages")
def image_dims(spark, d):
    dims = files.image_dims(files.scan_files(spark, file_tree(spark, d)))
    return dims.select(S.file_name(F.col("path")).alias("name"), "width", "height")


@query("select c.id, case when c.id % 3 = 0 and c.id % 4 <> 0 then (c.id % 640 + 1)::int else c.width end as width, case when c.id % 3 = 0 and c.id % 4 <> 0 then (c.id % 480 + 1)::int else c.height end as height from cur c")
def metadata_stream(spark, d):
    """Metadata updates as a stream of files, in micro-batches, merged with the catalog on reading."""
    base = folder(spark)
    _updates(spark, d).repartition(3).write.parquet(f"{base}/updates")
    rows = spark.readStream.schema(spark.read.parquet(f"{base}/updates").schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/updates")
    streams.write_metadata(rows, f"{base}/applied", f"{base}/checkpoint").awaitTermination()
    return streams.with_metadata(current(spark, d), f"{base}/applied").select("id", "width", "height")


# --- the cache as files, written by the sink and read back


def _cache_entries(spark, d):
    v = F.col("vec_id")
    dims = {"source_width": F.lit(4000), "source_height": F.lit(3000), "width": v % 3 + 1, "height": F.lit(1)}
    pixels = F.unhex(F.repeat(F.lit("01020304"), (v % 3 + 1).cast("int")))
    rows = caches.encode(table(spark, d, "embeddings").withColumns(dims | {"pixels": pixels}))
    end = F.when(v % 10 == 3, ".rgba.tmp-1").otherwise(".rgba")
    broken = F.when(v % 7 == 0, F.substring("content", 1, 20)).otherwise(F.col("content"))
    return rows.select(F.concat(v.cast("string"), end).alias("name"), broken.alias("content"))


_ENTRIES = """, entries as (select vec_id, vec_id || case when vec_id % 10 = 3 then '.rgba.tmp-1' else '.rgba' end as name, case when vec_id % 7 = 0 then 20 else 24 + 4 * (vec_id % 3 + 1) end as size from embeddings)"""


def _cache_folder(spark, d):
    base = folder(spark).removeprefix("file://") + "/cache"
    sink.write_files(_cache_entries(spark, d), base)
    return base


@query(_ENTRIES + " select count(*) filter (name like '%.tmp-%') as leftovers, count(*) filter (name not like '%.tmp-%') as n_files, coalesce(sum(size) filter (name not like '%.tmp-%'), 0)::bigint as bytes from entries")
def cache_files_inventory(spark, d):
    """Files of a cache folder, counted without reading them."""
    return caches.inventory(sink.cache_files(spark, _cache_folder(spark, d)))


@query(_ENTRIES + """ select name, vec_id % 7 <> 0 as valid, case when vec_id % 7 <> 0 then 4000::bigint end as source_width, case when vec_id % 7 <> 0 then 3000::bigint end as source_height,
  case when vec_id % 7 <> 0 then (vec_id % 3 + 1)::bigint end as width, case when vec_id % 7 <> 0 then 1::bigint end as height from entries where name not like '%.tmp-%'""")
def cache_files_decode(spark, d):
    """Headers of the finished files of a cache folder."""
    rows = sink.cache_files(spark, _cache_folder(spark, d), "*.rgba").withColumnRenamed("name", "path")
    return caches.decode_header(rows).withColumnRenamed("path", "name")


@query(_ENTRIES + """, first as (select * from entries where name not like '%.tmp-%' and vec_id % 2 = 0),
second as (select name, size from entries where name not like '%.tmp-%' and vec_id % 3 <> 0)
select (select count(*) from first) as files, (select sum(size) from first)::bigint as bytes, (select sum(size) from first)::bigint as delta
union all select count(*), sum(s.size + 1)::bigint, sum(s.size + 1 - coalesce(f.size, 0))::bigint from second s left join first f on s.name = f.name""")
def cache_files_written(spark, d):
    """Two writes to one cache folder: files, bytes, and by how much it grew."""
    base = folder(spark).removeprefix("file://") + "/cache"
    rows, number = _cache_entries(spark, d).where("name not like '%.tmp-%'"), F.expr("cast(split(name, '[.]')[0] as long)")
    sink.write_files(rows.where(number % 2 == 0), base)
    sink.write_files(rows.where(number % 3 != 0).withColumn("content", F.concat("content", F.lit(b"x"))), base)
    return sink.commits(spark, base).select("files", "bytes", "delta")
