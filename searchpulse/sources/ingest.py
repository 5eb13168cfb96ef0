"""Landing of events: wire format, rejects, partitioned files, schema discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchpulse.functions.columns import iso_utc
from searchpulse.operators.consolidate import canonical_log
from searchpulse.schemas import SEARCH_EVENT_WIRE

HOUR_PARTITIONS = ["year", "month", "day", "hour"]
CORRUPT = "_corrupt_record"


def to_wire(log: DataFrame, *kept: str) -> DataFrame:
    """Events as keyed JSON messages: key is the user, value the JSON object; ``kept`` columns stay."""
    names = [f.name for f in SEARCH_EVENT_WIRE.fields if f.name in log.columns]
    columns = [iso_utc(F.col(n)).alias(n) if n == "timestamp" else F.col(n) for n in names]
    return log.select(F.col("user_id").alias("key"), F.to_json(F.struct(*columns)).alias("value"), *kept)


def parse_wire(messages: DataFrame, value: str = "value") -> DataFrame:
    """Parse JSON messages by the declared schema; works on batches and streams.

    ``reject_reason`` is null for good rows. Unreadable JSON and times that do
    not parse are kept with their reason instead of failing the job.
    """
    schema = T.StructType([*SEARCH_EVENT_WIRE.fields, T.StructField(CORRUPT, T.StringType())])
    record = F.from_json(value, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    # Going through a generator keeps the parse from being repeated in every filter
    # and column that is built on its fields.
    parsed = messages.select(F.col(value).alias("raw"), F.inline(F.array(record)))
    ts = F.try_to_timestamp("timestamp")
    reason = F.when(F.col(CORRUPT).isNotNull() | (F.trim("raw") == ""), "unreadable record").when(ts.isNull(), "bad timestamp")
    return canonical_log(parsed).withColumns({"timestamp": ts, "reject_reason": reason}).drop(CORRUPT)


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good events, rejected messages)."""
    good = parsed.where(F.col("reject_reason").isNull()).drop("raw", "reject_reason")
    bad = parsed.where(F.col("reject_reason").isNotNull()).select("raw", "reject_reason")
    return good, bad


def with_hour_partitions(df: DataFrame, ts: Column) -> DataFrame:
    """Zero-padded year/month/day/hour folder columns."""
    return df.withColumns(
        {
            "year": F.date_format(ts, "yyyy"),
            "month": F.date_format(ts, "MM"),
            "day": F.date_format(ts, "dd"),
            "hour": F.date_format(ts, "HH"),
        }
    )


#: Folder of a landed table that holds what could not be read.
ERRORS = "errors"


def land_ndjson(log: DataFrame, path: str, ts: str = "timestamp") -> None:
    """One JSON object per line below year/month/day/hour folders."""
    (
        with_hour_partitions(log, F.col(ts))
        .hint("rebalance", *HOUR_PARTITIONS)
        .write.mode("append")
        .partitionBy(*HOUR_PARTITIONS)
        .json(path)
    )


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Landed NDJSON with its folder columns as text."""
    folders = [T.StructField(p, T.StringType()) for p in HOUR_PARTITIONS]
    return spark.read.schema(T.StructType([*schema.fields, *folders])).json(path)


def publish_keyed(log: DataFrame, path: str | None = None, options: dict[str, str] | None = None) -> None:
    """Write keyed messages to a topic, or to files when ``path`` is given.

    Messages without a key are not sent. No repartitioning by key here: the broker routes by key, and a user with a
    large share of the events would otherwise fill one task.
    """
    messages = to_wire(log).where("key IS NOT NULL")
    if path is not None:
        messages.write.mode("append").parquet(path)
    else:
        messages.write.format("kafka").options(**(options or {})).save()


def publish_summary(sent: DataFrame, published: DataFrame) -> DataFrame:
    """total, success and failed: what was to be sent, what arrived, and the difference."""
    total = sent.agg(F.count("*").alias("n")).scalar()
    return published.agg(F.count("*").alias("success")).select(
        total.alias("total"), "success", (total - F.col("success")).alias("failed")
    )


def discover(spark: SparkSession, path: str) -> DataFrame:
    """Read a Parquet dataset whose files have gained columns over time.

    Schemas are merged over all files, folder columns included; rows of older
    files have nulls in the newer columns. Files below an ``errors`` folder of the
    root are not part of the table.
    """
    reader = spark.read.option("mergeSchema", "true").option("basePath", path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tops = [s.getPath().getName() for s in store.listStatus(root)]
    kept = [f"{path}/{name}" for name in tops if name != ERRORS and not name.startswith(("_", "."))]
    return reader.parquet(*kept)


#: Fixed order in which types give way to each other when a column has several.
WIDTH = ["tinyint", "smallint", "int", "bigint", "double", "string"]


def wider(a: str, b: str) -> str:
    """The type that holds values of both: along ``WIDTH``, with float as double; anything else meets in text."""
    if a == b:
        return a
    a, b = ("double" if t == "float" else t for t in (a, b))
    if a in WIDTH and b in WIDTH:
        return max(a, b, key=WIDTH.index)
    if {a, b} <= {"date", "timestamp", "timestamp_ntz"} and "date" in (a, b):
        return a if b == "date" else b
    return a if a == b else "string"


def _table_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the data files below the root but for the folder of errors, in order."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    kept = listing.where(~F.regexp_extract("path", "([^/]+)/[^/]*$", 1).isin(ERRORS)).select("path")
    return sorted(row.path for row in kept.toLocalIterator())


def generations(spark: SparkSession, path: str) -> list[DataFrame]:
    """The table in parts whose files agree on the types of their columns.

    Spark merges the schemas of many files at once, reading footers in parallel;
    where types conflict the list is halved. Types change seldom, so a table of a few
    generations takes a few merges, not one a file. Only file names pass through the driver.
    """

    def read(files: list[str]) -> DataFrame:
        return spark.read.option("mergeSchema", "true").option("basePath", path).parquet(*files)

    def agree(a: list[str], b: list[str]) -> bool:
        """Whether two files have the same types where they have the same columns."""
        left, right = dict(read(a).dtypes), dict(read(b).dtypes)
        return all(right.get(c, t) == t for c, t in left.items())

    def parts(files: list[str]) -> list[list[str]]:
        if len(files) == 1:
            return [files]
        # two footers tell most conflicts, before a job over all of them fails
        if agree(files[:1], files[-1:]):
            try:
                read(files)
                return [files]
            except Exception as error:
                if "CANNOT_MERGE" not in str(error):
                    raise
        half = len(files) // 2
        return parts(files[:half]) + parts(files[half:])

    found: list[tuple[dict, list[str]]] = []
    for files in parts(_table_files(spark, path)):
        types = dict(read(files).dtypes)
        # files of one generation may lie apart in the list
        for known, listed in found:
            if all(known.get(c, t) == t for c, t in types.items()):
                known.update(types)
                listed.extend(files)
                break
        else:
            found.append((types, list(files)))
    return [read(files) for _, files in found]


def discover_widened(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """A Parquet dataset whose columns have gained others or changed type, and the columns that changed, with their types.

    Every column has the narrowest type that holds all its values; each generation
    of files is read with its own types and cast.
    """
    parts = generations(spark, path)
    seen: dict[str, list[str]] = {}
    for part in parts:
        for name, kind in part.dtypes:
            if kind not in seen.setdefault(name, []):
                seen[name].append(kind)
    types = {name: reduce(wider, kinds) for name, kinds in seen.items()}
    cast = [part.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) for c in part.columns]) for part in parts]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)
    return whole.select(*[f"`{c}`" for c in types]), {c: kinds for c, kinds in seen.items() if len(kinds) > 1}


def register_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Catalogue a Parquet folder as an external table with its partitions.

    Run again after new data has landed: columns and partitions that appeared
    are added, nothing is removed.
    """
    if not spark.catalog.tableExists(name):
        spark.catalog.createTable(name, path=path, source="parquet", mergeSchema="true")
    known = {f.name for f in spark.table(name).schema.fields}
    added = [f for f in discover(spark, path).schema.fields if f.name not in known]
    if added:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added)
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({columns})")
    if any(c.isPartition for c in spark.catalog.listColumns(name)):
        spark.catalog.recoverPartitions(name)
    return spark.table(name)
