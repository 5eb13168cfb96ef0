"""Object-key rules of the file re-encoder, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from searchpulse.functions.columns import any_of

# What counts as a log file and which path parts carry a date.
LOG_EXTENSIONS = [".log", ".json", ".txt", ".csv"]
LOG_FOLDERS = ["logs/", "raw-data/", "search-queries/"]
DATE_PARTS = ["year=", "month=", "day=", "hour="]
COMPRESSED_PREFIX = "compressed/"


def looks_like_log(key: Column) -> Column:
    lowered = F.lower(key)
    return any_of([lowered.endswith(e) for e in LOG_EXTENSIONS]) | any_of(
        [lowered.contains(f) for f in LOG_FOLDERS]
    )


def is_compressed(key: Column, prefix: str = COMPRESSED_PREFIX) -> Column:
    """Case-sensitive, like the keys themselves."""
    done = key.endswith(".gz")
    return done | key.startswith(prefix) if prefix else done


def needs_compression(key: Column, prefix: str = COMPRESSED_PREFIX) -> Column:
    return looks_like_log(key) & ~is_compressed(key, prefix)


def compressed_key(key: Column, prefix: str = COMPRESSED_PREFIX) -> Column:
    """Target key of a re-encoded object.

    Below a prefix only the date folders survive; without one the key just gets
    the ``.gz`` suffix (once).
    """
    if not prefix:
        return F.when(key.endswith(".gz"), key).otherwise(F.concat(key, F.lit(".gz")))
    parts = F.split(key, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    dated = F.filter(folders, lambda p: any_of([p.contains(d) for d in DATE_PARTS]))
    name = F.concat(F.element_at(parts, -1), F.lit(".gz"))
    return F.concat(F.lit(prefix), F.array_join(F.array_append(dated, name), "/"))
