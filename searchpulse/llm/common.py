"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchpulse.session import work_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# One byte per byte of UTF-8 text: A-Z lower-cased, every other ASCII byte that is no letter or digit a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(col, UPPER, LOWER)


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased; null has none."""
    return text.encode().translate(WORD_BYTES).split() if text else []


def blank_words(text: str | None) -> list[bytes]:
    """Runs between ASCII white space, A-Z lower-cased; null has none."""
    return text.encode().lower().split() if text else []


def lowered(column):
    """An Arrow string column with A-Z in lower case and nulls as empty texts.

    It is copied first: Arrow's ASCII kernels misread columns that are slices.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    whole = pc.fill_null(column, "").cast(pa.large_string()).take(pa.array(np.arange(len(column))))
    return pc.ascii_lower(whole)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once below the shared folder and read back: work is not repeated and lineage ends."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder_of_id(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


def per_process(key, make):
    """``make()`` once in a worker process, shared by all tasks that it runs."""
    import types

    held = sys.modules.setdefault("_searchpulse_worker", types.ModuleType("_searchpulse_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def give_back() -> None:
    """Return memory that Arrow and the allocator hold but no longer use, at the end of a task."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries have it
        pass


def by_bytes(batches, column: int, limit: int, rows: int = 1 << 30):
    """Slices of record batches of about ``limit`` bytes in a string column, and ``rows`` rows, at most; a longer text is alone."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            held = ends[at - 1] if at else 0
            stop = min(max(at + 1, int(np.searchsorted(ends, held + limit, "right"))), at + rows)
            yield batch.slice(at, stop - at)
            at = stop


def share(spark: SparkSession, value):
    """Broadcast an object of this package by value; the returned function gives it back once in each task."""
    import pickle

    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)
