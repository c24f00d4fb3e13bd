"""The catalog's schema and domains."""

from pyspark.sql import types as T

CATALOG = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("root", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("relative_path", T.StringType(), False),
    T.StructField("file_name", T.StringType(), False),
    T.StructField("size", T.LongType(), False),
    T.StructField("modified_ns", T.LongType(), False),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("format", T.StringType(), False),
    T.StructField("thumbnail_key", T.StringType(), False),
])
# Fixed values.
FORMATS = ("jpg", "jpeg", "png", "webp", "gif", "bmp", "tif", "tiff", "ico")
SORT_MODES = {"modified": "Modified (newest)", "natural": "Name", "size": "Size (largest)", "path": "Path"}
ACTIONS = ("copy", "move", "recycle_delete", "permanent_delete")
POLICIES = ("ask", "overwrite", "skip", "auto_rename")
QUEUE_CAPS = {"preview": 8, "visible": 128, "prefetch": 128, "results": 64, "metadata": 1024, "file_op": 8}
CACHE_MAGIC = "RIPTHM2\0"
DISK_HIGH, DISK_LOW, TEXTURE_BUDGET = 1 << 30, 800 << 20, 256 << 20
FIRST_BATCH, NEXT_BATCH = 128, 512
KEY_VERSION = "thumb-v2-256"


def storage_locations(base: str) -> dict[str, str]:
    """Where a catalog and its caches lie below a base folder."""
    return {"catalog": f"{base}/data/catalog", "thumbnails": f"{base}/data/cache/thumbnails"}


def decoder_threads(cores: int) -> int:
    """Workers that decode images: one core is left to the rest, two work at least and eight at most."""
    return max(2, min(8, cores - 1))
