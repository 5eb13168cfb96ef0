"""Settings of the daily trend run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TrendConfig:
    """Everything a daily run needs besides the data and the date.

    The defaults are the published behaviour: seven days of history, a floor of
    five searches per query-day, ten clusters, five queries per cluster, fifty
    ranked rows, thirty days of visibility.
    """

    recent_days: int = 7
    min_query_count: int = 5
    cluster_count: int = 10
    max_iterations: int = 20
    seed: int = 42
    num_features: int = 1000
    min_doc_freq: int = 2
    remove_stop_words: bool = True
    # Partitions of the fit's distinct vectors; by default their number follows that of the vectors.
    feature_partitions: int | None = None
    per_cluster: int | None = 5
    top_n: int = 50
    label_texts: int = 10
    ttl_days: int = 30
    with_growth: bool = False
    # Also keep a sketch of each query-day's users, for distinct users over any range.
    with_user_sketches: bool = False
