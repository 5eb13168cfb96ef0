"""The daily run: consolidate, cluster, label, rank, store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchpulse.config import TrendConfig
from searchpulse.functions.columns import as_date
from searchpulse.functions.joins import counted_side, join_null_safe
from searchpulse.operators.cluster import cluster_queries, group_stats
from searchpulse.operators.consolidate import (
    changed_dates,
    consolidate,
    recent,
    recent_high_volume,
    rows_of_dates,
    write_by_date,
)
from searchpulse.operators.feed import ArrivalFeed, date_prints
from searchpulse.operators.growth import day_growth
from searchpulse.operators.index import refresh_index
from searchpulse.operators.label import attach_labels, label_by_keywords, label_with, text_lists, top_texts
from searchpulse.operators.rank import clustered_for_date, rank_trends, result_rows, store_results, top_per_cluster
from searchpulse.operators.retention import drop_folders
from searchpulse.operators.users import user_sketches
from searchpulse.schemas import CLUSTERED, CONSOLIDATED, RESULT_ROW
from searchpulse.session import ensure_checkpoint_dir


#: Columns of the results that have an index of their own.
INDEXED = ("category", "cluster_id")


@dataclass(frozen=True)
class Tables:
    """Where the stages keep their output, below one root."""

    root: str

    @property
    def consolidated(self) -> str:
        return f"{self.root}/consolidated-queries"

    @property
    def date_prints(self) -> str:
        return f"{self.root}/date-prints"

    @property
    def feed(self) -> str:
        return f"{self.root}/feed"

    @property
    def user_sketches(self) -> str:
        return f"{self.root}/user-sketches"

    def index(self, column: str) -> str:
        return f"{self.root}/results-by-{column}"

    @property
    def clustered(self) -> str:
        return f"{self.root}/clustered-queries"

    @property
    def cluster_stats(self) -> str:
        return f"{self.root}/cluster-stats"

    @property
    def cluster_texts(self) -> str:
        return f"{self.root}/cluster-texts"

    @property
    def results(self) -> str:
        return f"{self.root}/results"


def consolidate_stage(
    log: DataFrame,
    tables: Tables,
    as_of: str,
    cfg: TrendConfig = TrendConfig(),
    new_rows: DataFrame | None = None,
    feed: ArrivalFeed | None = None,
) -> None:
    """Redo the dates that have changed since the run before, however old; other dates stay as stored.

    A ``feed`` over the landed log finds them by itself and reads only folders that
    have changed or hold one of these dates. Without it, ``new_rows`` are the rows landed since the
    run before, whose dates are redone together with those that the run for ``as_of`` reads. Without
    either, the fingerprints of all dates of the log are compared with those of the run before.
    The first run consolidates all dates.
    """
    spark = log.sparkSession
    ensure_checkpoint_dir(spark)
    if feed is not None:
        dates = feed.touched_dates().checkpoint()
        _redo(spark, tables, feed.rows_of(dates), dates, feed.present_dates(), cfg)
        feed.commit()
        return
    held = _stored_prints(spark, tables)
    if held is None or new_rows is None:
        prints = date_prints(log).checkpoint()
        dates = prints.select("date") if held is None else changed_dates(prints, held).checkpoint()
        rows = log if held is None else rows_of_dates(log, dates)
    else:
        since = F.date_sub(as_date(as_of), max(cfg.recent_days - 1, 1))
        window = spark.range(1).select(F.explode(F.sequence(since, as_date(as_of))).alias("date"))
        touched = new_rows.select(F.to_date("timestamp").alias("date"))
        dates = touched.union(window).distinct().checkpoint()
        rows = rows_of_dates(log, dates)
        others = held.join(dates.select(F.col("date").alias("_date")), F.col("date").eqNullSafe(F.col("_date")), "left_anti")
        prints = others.unionByName(date_prints(rows)).checkpoint()
    _redo(spark, tables, rows, dates, prints.select("date"), cfg)
    prints.coalesce(1).write.mode("overwrite").parquet(tables.date_prints)


def _stored_prints(spark: SparkSession, tables: Tables) -> DataFrame | None:
    """Fingerprints of the dates as they were consolidated; None before the first run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(tables.date_prints)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("date date, n long, print long, total long").parquet(tables.date_prints)


def _redo(spark: SparkSession, tables: Tables, rows: DataFrame, dates: DataFrame, present: DataFrame, cfg: TrendConfig) -> None:
    """Write the query-days of the given dates; one that is not ``present`` any more goes."""
    write_by_date(consolidate(rows), tables.consolidated)
    named = present.select(F.col("date").alias("_date")).distinct()
    gone = dates.join(named, F.col("date").eqNullSafe(F.col("_date")), "left_anti")
    drop_folders(spark, tables.consolidated, gone, ["date"])
    if cfg.with_user_sketches:
        write_by_date(user_sketches(rows), tables.user_sketches)
        drop_folders(spark, tables.user_sketches, gone, ["date"])


def cluster_stage(spark: SparkSession, tables: Tables, as_of: str, run_ts: str, cfg: TrendConfig) -> int:
    """Cluster the recent high-volume rows; earlier dates of the clustered table stay."""
    daily = spark.read.schema(CONSOLIDATED).parquet(tables.consolidated)
    picked = recent_high_volume(daily, as_of, cfg.recent_days, cfg.min_query_count)
    picked = picked.where(F.col("date") <= as_date(as_of))
    result = cluster_queries(picked, run_ts, cfg)
    write_by_date(result.rows, tables.clustered)
    stored = spark.read.schema(CLUSTERED).parquet(tables.clustered)
    written = recent(stored, as_of, cfg.recent_days).where(F.col("date") <= as_date(as_of))
    stats = group_stats(written, sample=cfg.label_texts, order=("date",))
    stats.write.mode("overwrite").parquet(tables.cluster_stats)
    texts = written.select("cluster_id", "query_text", F.col("date").alias("day"))
    texts.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(tables.cluster_texts)
    return result.k


def rank_stage(
    spark: SparkSession,
    tables: Tables,
    as_of: str,
    run_ts: str,
    cfg: TrendConfig,
    label_fn: Callable[[list[str]], str] | None = None,
) -> None:
    """Label the date's clusters, rank their top queries and replace the date's results."""
    day = clustered_for_date(spark, tables.clustered, as_of, CLUSTERED)
    top = day if cfg.per_cluster is None else top_per_cluster(day, cfg.per_cluster)
    if cfg.with_growth:
        pair = spark.read.schema(CONSOLIDATED).parquet(tables.consolidated).where(
            F.col("date").between(F.date_sub(as_date(as_of), 1), as_date(as_of))
        )
        if cfg.per_cluster is not None:
            wanted = counted_side(top.select(F.col("query_text").alias("_wanted")).distinct())
            pair = pair.join(wanted, F.col("query_text").eqNullSafe(F.col("_wanted")), "left_semi")
        growth = day_growth(pair).where(F.col("date") == as_date(as_of)).select("query_text", "date", "growth_rate")
        top = join_null_safe(top, growth, ["query_text", "date"], "left")
    texts = top_texts(top, cfg.label_texts)
    labels = label_by_keywords(texts) if label_fn is None else label_with(text_lists(texts), label_fn)
    items = rank_trends(attach_labels(top, labels), cfg.top_n)
    store_results(result_rows(items, run_ts, cfg.ttl_days), tables.results)
    written = spark.range(1).select(as_date(as_of).alias("date"))
    for column in INDEXED:
        refresh_index(stored_results(spark, tables), tables.index(column), column, written)


def run_daily(
    log: DataFrame,
    tables: Tables,
    as_of: str,
    run_ts: str,
    cfg: TrendConfig = TrendConfig(),
    label_fn: Callable[[list[str]], str] | None = None,
    new_rows: DataFrame | None = None,
    feed: ArrivalFeed | None = None,
) -> DataFrame:
    """All stages for ``as_of``; returns the stored rows of that date.

    Late and corrected rows of any date reach the consolidated table, found by ``feed``,
    by ``new_rows`` or by fingerprints (see ``consolidate_stage``).

    Every stage reads the written output of the one before, so each can be run
    again alone. Errors are raised, not reported as results.
    """
    spark = log.sparkSession
    consolidate_stage(log, tables, as_of, cfg, new_rows, feed)
    cluster_stage(spark, tables, as_of, run_ts, cfg)
    rank_stage(spark, tables, as_of, run_ts, cfg, label_fn)
    return stored_results(spark, tables).where(F.col("date") == as_date(as_of))


def stored_results(spark: SparkSession, tables: Tables) -> DataFrame:
    """The results table of all dates; empty, with its schema, before the first row."""
    return spark.read.schema(RESULT_ROW).parquet(tables.results)
