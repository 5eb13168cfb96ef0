"""Category labels for clusters: prompt text, injected labeller, keyword default."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchpulse.functions.joins import counted_side
from searchpulse.functions.text import normalised_label, tokens

# The closed label list and the two fallbacks.
LABELS = [
    "education",
    "entertainment",
    "technology",
    "shopping",
    "health",
    "news",
    "travel",
    "finance",
    "sports",
    "other",
]
UNCATEGORIZED = "uncategorized"
OTHER = "other"

# Default keyword dictionary of the offline labeller.
KEYWORDS = {
    "education": "course courses tutorial tutorials learn degree certification bootcamp practice interview".split(),
    "entertainment": "movie music game series concert film".split(),
    "technology": "python programming cloud docker kubernetes software api database data code git machine".split(),
    "shopping": "buy price discount sale shop cheap".split(),
    "health": "doctor diet symptoms fitness medicine health".split(),
    "news": "news election weather breaking headlines".split(),
    "travel": "flight hotel trip travel visa beach".split(),
    "finance": "stock bank loan tax insurance cost".split(),
    "sports": "football basketball tennis score league marathon".split(),
}


def top_texts(df: DataFrame, n: int = 10, key: str = "cluster_id", order: tuple[str, ...] = ()) -> DataFrame:
    """Up to ``n`` texts per cluster by volume, as rows with their position."""
    by_volume = Window.partitionBy(key).orderBy(F.desc("query_count"), "query_text", *order)
    return (
        df.withColumn("position", F.row_number().over(by_volume))
        .where(F.col("position") <= n)
        .select(key, "position", "query_text")
    )


def text_lists(texts: DataFrame, key: str = "cluster_id") -> DataFrame:
    """One array of (at most n) texts per cluster, in position order."""
    return texts.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("position", "query_text")))["query_text"].alias("texts")
    )


def label_prompt(texts: Column) -> Column:
    """Instruction text for one cluster: label list and the texts as bullets."""
    bullets = F.array_join(F.transform(texts, lambda t: F.concat(F.lit("- "), t)), "\n")
    # Fixed value: wording of the instruction.
    return F.concat(
        F.lit("Analyze the following search queries and classify them into a single category.\n"
              "Choose from these categories: " + ", ".join(LABELS) + ".\n\nSearch queries:\n"),
        bullets,
        F.lit("\n\nRespond with only the category name, nothing else."),
    )


def label_with(
    texts: DataFrame,
    label_fn: Callable[[list[str]], str],
    key: str = "cluster_id",
    attempts: int = 3,
    delay: float = 2.0,
    throttled: tuple[type[Exception], ...] = (TimeoutError,),
    tasks: int = 16,
) -> DataFrame:
    """Call ``label_fn`` once per cluster, inside the tasks.

    ``texts`` holds one array per cluster. The ``throttled`` errors wait 2, 4, ...
    seconds, any other failure a fixed delay; after the last attempt the label is
    ``uncategorized``. Replies are trimmed and lower-cased but not forced into
    the label list.
    """
    key_type = texts.schema[key].dataType.simpleString()

    def ask(items: list[str]) -> str:
        for attempt in range(attempts):
            try:
                return str(label_fn(items)).strip().lower()
            except throttled:
                pause = delay * 2**attempt
            except Exception:
                pause = delay
            if attempt < attempts - 1:
                time.sleep(pause)
        return "uncategorized"

    def run(batches):
        for batch in batches:
            labels = [ask(list(items)) for items in batch["texts"]]
            yield batch[[key]].assign(category=labels)

    # one cluster per task as far as possible: a call may wait for a remote service
    spread = texts.select(key, "texts").repartition(tasks, key)
    return spread.mapInPandas(run, f"{key} {key_type}, category string")


def label_by_keywords(
    texts: DataFrame,
    keywords: dict[str, list[str]] = KEYWORDS,
    key: str = "cluster_id",
) -> DataFrame:
    """Offline labeller: the category whose keywords occur most in the cluster's texts.

    Ties go to the first category by name, clusters without a keyword to
    ``other``. ``texts`` holds rows (cluster, position, query_text); the keyword
    table is a literal of fixed size, looked up as a map instead of joined.
    """
    pairs = [F.lit(x) for category, words in keywords.items() for w in words for x in (w, category)]
    lookup = F.create_map(*pairs)
    hits = (
        texts.select(key, F.explode(tokens(F.col("query_text"))).alias("term"))
        .select(key, F.element_at(lookup, F.col("term")).alias("category"))
        .groupBy(key, "category")
        .agg(F.count("category").alias("hits"))
    )
    best = Window.partitionBy(key).orderBy(F.desc("hits"), F.col("category").asc_nulls_last())
    return (
        hits.withColumn("_rn", F.row_number().over(best))
        .where(F.col("_rn") == 1)
        .select(key, F.coalesce("category", F.lit(OTHER)).alias("category"))
    )


def attach_labels(df: DataFrame, labels: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Left join of the cluster label; rows without one become ``other``.

    The labels, one row per cluster, are measured and broadcast if they are small:
    the rows then stay where they are, however few keys they have.
    """
    return df.join(counted_side(labels), key, "left").withColumn("category", F.coalesce("category", F.lit(OTHER)))


def normalise_labels(df: DataFrame, col: str = "category", labels: list[str] = LABELS) -> DataFrame:
    label = normalised_label(F.col(col))
    return df.withColumn(col, label).withColumn("in_label_set", F.col(col).isin(labels))
