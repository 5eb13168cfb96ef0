"""K-means over query features, and per-cluster statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchpulse.config import TrendConfig
from searchpulse.functions.joins import join_null_safe
from searchpulse.operators.features import idf_stage, term_stages
from searchpulse.session import ensure_checkpoint_dir

# The columns of a clustered row.
RESULT_COLUMNS = [
    "query_text",
    "date",
    "query_count",
    "unique_users",
    "avg_results_count",
    "click_through_rate",
    "cluster_id",
]


class NoRecentQueries(ValueError):
    """Nothing is left to cluster after the recency and volume filters."""


def choose_k(rows: int, requested: int) -> int:
    """Requested number of clusters, or half the rows (at least two) when rows are short."""
    return requested if rows >= requested else max(2, rows // 2)


def choose_k_column(rows: Column, requested: int) -> Column:
    """The same rule as a column, for per-group planning."""
    half = F.floor(rows / 2).cast("int")
    return F.when(rows >= requested, F.lit(requested)).otherwise(F.greatest(F.lit(2), half))


@dataclass
class Clustering:
    rows: DataFrame
    k: int
    features: PipelineModel
    model: KMeansModel | None
    cost: float


#: Distinct vectors that one partition of the fit holds.
VECTORS_IN_PARTITION = 20_000


def weighted_vectors(features: DataFrame, partitions: int | None = None, text_col: str = "query_text") -> tuple[DataFrame, int]:
    """Distinct feature vectors with their number of rows as ``weight``, laid out by themselves, and how many they are.

    A vector goes to a partition, and to its place there, by the smallest text that has
    it, and the number of partitions follows that of the vectors unless it is given. A seeded
    fit starts from the same rows in the same places on every cluster.
    """
    grouped = features.groupBy("features").agg(F.count("*").cast("double").alias("weight"), F.min(text_col).alias("_first"))
    grouped = grouped.checkpoint()
    number = grouped.count()
    parts = partitions or max(1, -(-number // VECTORS_IN_PARTITION))
    placed = grouped.repartition(parts, "_first").sortWithinPartitions("_first", F.xxhash64("features"))
    return placed.checkpoint(), number


def final_cost(model: KMeansModel, distinct: DataFrame) -> float:
    """Sum of the weighted squared distances of the fitted vectors to the centres they end in.

    The summary's training cost is that of the centres before the last update, not of the model.
    """
    import numpy as np
    import pandas as pd

    centres = np.array(model.clusterCenters())

    def costs(frames):
        for frame in frames:
            x = np.stack(frame["x"].to_list()) if len(frame) else np.zeros((0, centres.shape[1]))
            apart = x - centres[frame["cluster_id"].to_numpy()]
            yield pd.DataFrame({"cost": [float(((apart**2).sum(1) * frame["weight"].to_numpy()).sum())]})

    assigned = model.transform(distinct).select(vector_to_array("features").alias("x"), "cluster_id", "weight")
    return float(assigned.mapInPandas(costs, "cost double").agg(F.sum("cost")).head()[0] or 0.0)


def cluster_queries(
    daily: DataFrame,
    run_ts: str,
    cfg: TrendConfig = TrendConfig(),
    key: tuple[str, ...] = ("query_text", "date"),
) -> Clustering:
    """Fit and apply TF-IDF + K-means to already filtered query-day rows.

    The rows are checkpointed with their hashed term counts: scan, filters
    and tokenising run once, and a lost executor costs a re-read. The fit runs over the
    distinct vectors, weighted by their rows (see ``weighted_vectors``), so its input
    is the same whatever the layout of the source, the session and the number of rows with
    the same text.
    """
    spark = daily.sparkSession
    ensure_checkpoint_dir(spark)
    stages = term_stages(cfg)
    counted = PipelineModel(stages).transform(daily).drop("words", "filtered_words").checkpoint()
    n_rows = counted.count()
    if n_rows == 0:
        raise NoRecentQueries("no query-day rows left after filtering")
    idf = idf_stage(cfg).fit(counted)
    pipeline = PipelineModel([*stages, idf])
    features = idf.transform(counted)

    distinct, n_distinct = weighted_vectors(features, cfg.feature_partitions)
    k = min(choose_k(n_rows, cfg.cluster_count), n_distinct)
    if k < 2:
        # All rows have the same features: one cluster, its own centre, no fit.
        model, cost = None, 0.0
        assigned = features.withColumn("cluster_id", F.lit(0))
    else:
        # Initialisation and tolerance.
        model = KMeans(
            k=k,
            seed=cfg.seed,
            maxIter=cfg.max_iterations,
            initMode="k-means||",
            tol=1e-4,
            featuresCol="features",
            predictionCol="cluster_id",
            weightCol="weight",
        ).fit(distinct)
        cost = final_cost(model, distinct)
        assigned = model.transform(features)
    kept = [c for c in RESULT_COLUMNS if c in assigned.columns]
    extra = [c for c in key if c not in kept]
    rows = assigned.select(*extra, *kept).withColumns(
        {"processing_timestamp": F.lit(run_ts), "cluster_count": F.lit(k)}
    )
    return Clustering(rows, k, pipeline, model, cost)


def cluster_sizes(clustered: DataFrame, key: str = "cluster_id") -> DataFrame:
    return clustered.groupBy(key).agg(F.count("*").alias("cluster_size"))


def group_stats(
    df: DataFrame, key: str = "cluster_id", sample: int | None = None, order: tuple[str, ...] = ()
) -> DataFrame:
    """Size, total and mean volume per group, with its first ``sample`` texts by volume if asked.

    The complete list of a group's texts are the rows themselves: one array per
    group would have to be built by one task.
    """
    stats = df.groupBy(key).agg(
        F.count("*").alias("cluster_size"),
        F.sum("query_count").alias("total_queries"),
        F.avg("query_count").alias("avg_query_count"),
    )
    if sample is None:
        return stats
    by_volume = Window.partitionBy(key).orderBy(F.desc("query_count"), "query_text", *order)
    top = (
        df.withColumn("_rn", F.row_number().over(by_volume))
        .where(F.col("_rn") <= sample)
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("_rn", "query_text")))["query_text"].alias("sample_queries"))
    )
    return join_null_safe(stats, top, [key], "left")
