"""Which days of a landed log have changed since the last run, and the rows of those days.

The log lies in folders (arrival hours). A state table holds for every folder a
signature of its files and, for every event date in it, the number of its rows and two
sums over their hashes. A run lists the files, reads only folders whose
signature is new, and finds the dates whose fingerprints differ: late rows, corrected rows
(also where their number stays the same) and removed files. The dates' rows are then read from the
folders that hold them. The state is written when the caller has used the result, so
a run that fails is simply repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from searchpulse.functions.joins import counted_side
from searchpulse.session import ensure_checkpoint_dir

PRINTS = ["n", "print", "total"]


def fingerprint(columns: list[str]) -> list[Column]:
    """Number of rows, XOR of their hashes and sum of 24 bits of each.

    Neither depends on the order of the rows. Equal rows cancel out in the XOR, but
    not in the sum, which stays within 64 bits for half a trillion rows.
    """
    row = F.xxhash64(*sorted(columns))
    return [
        F.count("*").alias("n"),
        F.bit_xor(row).alias("print"),
        F.sum(F.shiftrightunsigned(row, 40)).alias("total"),
    ]


def date_prints(log: DataFrame, time: str = "timestamp") -> DataFrame:
    """Fingerprint of every date of a log: columns date, n, print, total."""
    return log.groupBy(F.to_date(time).alias("date")).agg(*fingerprint(log.columns))


class ArrivalFeed:
    """Changes of a folder-partitioned log against the state below ``state_root``.

    ``folders`` are the log's partition columns; ``rows`` turns the stored rows
    into those that count (a projection and filter). The log's ``schema`` is
    inferred where it is not given.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        state_root: str,
        folders: list[str],
        rows: Callable[[DataFrame], DataFrame] | None = None,
        schema: StructType | None = None,
    ):
        self.spark, self.path, self.root, self.folders = spark, path, state_root, folders
        self.schema = schema
        self.project = rows or (lambda df: df)
        self._next: DataFrame | None = None

    # state

    def _store(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        """Numbers of the complete states."""
        root, store = self._store()
        if not store.exists(root):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath() for s in store.listStatus(root) if s.getPath().getName().startswith("version=")]
        return sorted(int(p.getName().split("=")[1]) for p in found if store.exists(path(p, "_SUCCESS")))

    def _held(self, listing: DataFrame) -> DataFrame:
        """The last state: a row for every folder and date."""
        kinds = ", ".join(f"`{f}` {listing.schema[f].dataType.simpleString()}" for f in self.folders)
        schema = f"{kinds}, listing long, date date, n long, print long, total long"
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/version={versions[-1]:09d}")

    # changes

    def _listing(self) -> DataFrame:
        """One signature for each folder, from names, lengths and times of its files."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.path)
        name = F.regexp_extract("path", "[^/]+$", 0)
        return files.groupBy(*self.folders).agg(F.bit_xor(F.xxhash64(name, "length", "modificationTime")).alias("listing"))

    def _in_folders(self, folders: DataFrame) -> DataFrame:
        """Stored rows of the given folders; other folders are not read."""
        ordered = [F.col(f).isNotNull() for f in self.folders]
        wanted = counted_side(folders.select(*self.folders).distinct())
        # a comparison on the small side lets Spark prune folders while it runs
        some = F.col(self.folders[0]).cast("string") >= F.lit("")
        self.schema = self.schema or self.spark.read.parquet(self.path).schema
        stored = self.spark.read.schema(self.schema).parquet(self.path)
        return stored.join(wanted.where(some & reduce(lambda a, b: a & b, ordered)), self.folders, "left_semi")

    def touched_dates(self) -> DataFrame:
        """Dates (null among them) whose rows are not those of the last run; all of them before the first."""
        ensure_checkpoint_dir(self.spark)
        listing = self._listing().checkpoint()
        held = self._held(listing)
        changed = listing.join(held.select(*self.folders, "listing").distinct(), [*self.folders, "listing"], "left_anti").checkpoint()
        rows = self.project(self._in_folders(changed))
        measured = [c for c in rows.columns if c not in self.folders]
        found = rows.groupBy(*self.folders, F.to_date("timestamp").alias("date")).agg(*fingerprint(measured))
        # a folder without rows that count keeps its signature in a row of its own
        found = changed.join(found, self.folders, "left").select(*held.columns).checkpoint()
        same = held.join(listing, [*self.folders, "listing"], "left_semi")
        gone = held.join(same.select(*self.folders).distinct(), self.folders, "left_anti")
        parts = [*self.folders, "date", *PRINTS]
        before, after = (df.where("n IS NOT NULL").select(*parts) for df in (gone, found))
        differing = before.exceptAll(after).unionByName(after.exceptAll(before))
        self._next = same.select(*held.columns).unionByName(found).checkpoint()
        return differing.select("date").distinct()

    def rows_of(self, dates: DataFrame) -> DataFrame:
        """Rows of the log on the given dates, read from the folders that hold some."""
        if self._next is None:
            raise RuntimeError("touched_dates comes first")
        named = dates.select(F.col("date").alias("_date")).distinct()
        within = F.col("date").eqNullSafe(F.col("_date"))
        folders = self._next.where("n IS NOT NULL").join(named, within, "left_semi")
        rows = self.project(self._in_folders(folders))
        return rows.join(counted_side(named), F.to_date("timestamp").eqNullSafe(F.col("_date")), "left_semi")

    def present_dates(self) -> DataFrame:
        """Dates that the log holds rows of, as found by ``touched_dates``."""
        if self._next is None:
            raise RuntimeError("touched_dates comes first")
        return self._next.where("n IS NOT NULL").select("date").distinct()

    def commit(self) -> None:
        """Keep what ``touched_dates`` found as the state that the next run compares with."""
        if self._next is None:
            raise RuntimeError("touched_dates comes first")
        version = (self._versions() or [0])[-1] + 1
        # overwrites what a failed run may have left under this number
        self._next.write.mode("overwrite").parquet(f"{self.root}/version={version:09d}")
        self._next = None
