"""File listing and gzip re-encoding of landed files, one output file per input file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchpulse.functions.columns import safe_ratio
from searchpulse.functions.keys import COMPRESSED_PREFIX, compressed_key, needs_compression
from searchpulse.session import ensure_checkpoint_dir

ENTRY_SCHEMA = "key string, length long, is_folder boolean"
RESULT_SCHEMA = (
    "key string, compressed_key string, success boolean, original_size long, compressed_size long, error string"
)
BYTES_PER_TASK = 256 * 1024 * 1024


class KeyCollision(ValueError):
    """Two input files would be written to the same compressed key."""


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Key (path below ``root``) and length of every file, empty files included.

    Folders are listed level by level, each level as one job over the folders
    found before, so neither the tree nor its files pass through the driver.
    Unlike Spark's own file sources it sees empty files and names that start with
    ``_`` or ``.``, which are files like any other here; only the markers and
    checksums that writers leave beside their files (``_SUCCESS``, ``.*.crc``) are not.
    """
    ensure_checkpoint_dir(spark)

    def read_folders(frames):
        import re

        import pandas as pd
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        base = base.rstrip("/")
        for frame in frames:
            for folder in frame["key"]:
                found = store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/")))
                found = [e for e in found if e.base_name != "_SUCCESS" and not re.fullmatch(r"\..*\.crc", e.base_name)]
                yield pd.DataFrame(
                    {
                        "key": [e.path[len(base) + 1 :] for e in found],
                        "length": [e.size or 0 for e in found],
                        "is_folder": [e.type == fs.FileType.Directory for e in found],
                    }
                )

    folders = spark.range(1).select(F.lit("").alias("key"))
    levels = []
    while True:
        entries = folders.mapInPandas(read_folders, ENTRY_SCHEMA).checkpoint()
        levels.append(entries.where(~F.col("is_folder")).select("key", "length"))
        inner = entries.where("is_folder").select("key")
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        folders = inner.repartition(spark.sparkContext.defaultParallelism, "key")


def plan_compression(files: DataFrame, prefix: str = COMPRESSED_PREFIX) -> DataFrame:
    """The files to re-encode with their target keys."""
    todo = files.where(needs_compression(F.col("key"), prefix))
    return todo.withColumn("compressed_key", compressed_key(F.col("key"), prefix))


def colliding_keys(plan: DataFrame) -> DataFrame:
    return plan.groupBy("compressed_key").agg(F.count("*").alias("files")).where(F.col("files") > 1)


def compress_files(
    spark: SparkSession,
    root: str,
    out_root: str,
    prefix: str = COMPRESSED_PREFIX,
    level: int = 6,
) -> DataFrame:
    """Write a .gz copy of every log file below ``root`` and report sizes per file.

    Two files that would share a target stop the job before anything is written.
    The copies are made when the returned report is evaluated. Files are streamed
    in pieces from inside the tasks, so their size is not bound by a task's
    memory. Each copy is written under a task-private name and then moved in
    place, so a repeated task leaves a complete file. Inputs are never deleted.
    """
    plan = plan_compression(list_files(spark, root), prefix)
    clash = colliding_keys(plan).limit(3).collect()
    if clash:
        raise KeyCollision(", ".join(r["compressed_key"] for r in clash))
    size = plan.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).head()
    tasks = max(1, min(size["files"], max(spark.sparkContext.defaultParallelism, size["bytes"] // BYTES_PER_TASK)))

    def run(frames):
        import gzip
        import uuid

        import pandas as pd
        from pyarrow import fs

        source_fs, source_base = fs.FileSystem.from_uri(root)
        target_fs, target_base = fs.FileSystem.from_uri(out_root)

        def encode(key, target_key):
            try:
                target = f"{target_base}/{target_key}"
                target_fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                size = 0
                with source_fs.open_input_stream(f"{source_base}/{key}", compression=None) as reader:
                    with target_fs.open_output_stream(part, compression=None) as sink:
                        with gzip.GzipFile(fileobj=sink, mode="wb", compresslevel=level, mtime=0) as zipped:
                            while piece := reader.read(1 << 20):
                                size += len(piece)
                                zipped.write(piece)
                target_fs.move(part, target)
                return key, target_key, True, size, target_fs.get_file_info(target).size, None
            except Exception as error:
                return key, target_key, False, None, None, str(error)

        columns = ["key", "compressed_key", "success", "original_size", "compressed_size", "error"]
        for frame in frames:
            rows = [encode(*row) for row in zip(frame["key"], frame["compressed_key"])]
            yield pd.DataFrame(rows, columns=columns).astype({"original_size": "Int64", "compressed_size": "Int64"})

    spread = plan.select("key", "compressed_key").repartition(int(tasks), "key")
    saved = F.col("original_size") - F.col("compressed_size")
    done = spread.mapInPandas(run, RESULT_SCHEMA)
    return done.withColumn("compression_ratio", safe_ratio(saved, F.col("original_size")))
