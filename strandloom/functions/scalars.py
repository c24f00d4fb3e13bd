"""Scalar functions over columns; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.schema import FORMATS, KEY_VERSION


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_lower(name: Column) -> Column:
    """What follows the last dot, in lower case; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1))


def file_stem(name: Column) -> Column:
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), F.regexp_extract(name, r"(?s)^(.+)\.[^.]*$", 1)).otherwise(name)


def relative_path(path: Column, root: Column) -> Column:
    inside = F.startswith(path, F.concat(root, F.lit("/")))
    return F.when(inside, F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def supported(name: Column) -> Column:
    return extension_lower(name).isin(*FORMATS)


def le8(x: Column) -> Column:
    """Eight bytes of a long, lowest first."""
    digits = F.lpad(F.hex(x), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, k, 2) for k in range(15, 0, -2)]))


def cache_key(path: Column, size: Column, modified_ns: Column) -> Column:
    return F.sha2(F.concat(F.encode(path, "UTF-8"), le8(size), le8(modified_ns), F.encode(F.lit(KEY_VERSION), "UTF-8")), 256)


def texture_key(key: Column, preview: Column) -> Column:
    return F.concat(key, F.when(preview, F.lit(":preview")).otherwise(F.lit(":thumb")))


def cache_file(key: Column) -> Column:
    return F.concat(key, F.lit(".rgba"))


def natural_key(name: Column) -> Column:
    """Chunks of a name: digit runs by value (length first), the rest in lower case."""
    digits = lambda x: F.regexp_replace(x, "^0+", "")
    chunk = lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lpad(F.length(digits(x)).cast("string"), 4, "0"), digits(x))).otherwise(x)
    return F.transform(F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), chunk)


def same_path(a: Column, b: Column) -> Column:
    flat = lambda p: F.translate(F.regexp_replace(p, r"[\\/]+$", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return flat(a) == flat(b)


def format_bytes(size: Column) -> Column:
    part = lambda unit, digits, name: F.format_string(f"%.{digits}f {name}", F.bround(size / F.lit(float(unit)), digits))
    return F.when(size >= 1 << 30, part(1 << 30, 2, "GiB")).when(size >= 1 << 20, part(1 << 20, 1, "MiB")).when(size >= 1 << 10, part(1 << 10, 1, "KiB")).otherwise(F.concat(size.cast("string"), F.lit(" B")))


def format_seconds(ms: Column) -> Column:
    """Seconds with two places; a half of the last place goes to the even one."""
    return F.format_string("%.2f", F.bround(ms / F.lit(1000.0), 2))


def hover_text(name: Column, width: Column, height: Column, size: Column, fmt: Column) -> Column:
    known = lambda x: F.coalesce(x.cast("string"), F.lit("?"))
    return F.concat_ws("\n", name, F.concat(known(width), F.lit(" x "), known(height)), format_bytes(size), F.upper(fmt))


def fit_scale(w, h, width: Column, height: Column, cap: bool) -> Column:
    scale = F.least(F.lit(float(w)) / width, F.lit(float(h)) / height)
    return F.least(scale, F.lit(1.0)) if cap else scale


def zoom(steps: Column) -> Column:
    """Zoom after scroll steps, each kept between 0.05 and 12."""
    return F.aggregate(steps, F.lit(1.0), lambda z, s: F.greatest(F.least(z * (F.lit(1.0) + s * F.lit(0.001)), F.lit(12.0)), F.lit(0.05)))


def rotate(turns: Column) -> Column:
    return F.pmod(turns + 1, F.lit(4))


def mtime_ns(ns: Column) -> Column:
    return F.coalesce(F.greatest(ns, F.lit(0)), F.lit(0)).cast("long")


def path_depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda x: x != ""))


def sort_label(mode: Column) -> Column:
    from strandloom.schema import SORT_MODES

    return F.element_at(F.create_map(*[F.lit(x) for pair in SORT_MODES.items() for x in pair]), mode)


def div_ceil(n: Column, d) -> Column:
    return F.ceil(n / F.lit(d)).cast("long")


def decoder_threads(cores: Column) -> Column:
    """Workers that decode images on machines with so many cores: one is left to the rest, two work at least and eight at most."""
    return F.greatest(F.lit(2), F.least(F.lit(8), cores - 1))
