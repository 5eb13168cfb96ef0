"""Search-log generator whose rows depend only on (seed, id).

Draws are slices of one digest per row, so the result does not change with the
partitioning, a retried task or the number of executors (``rand(seed)`` would).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchpulse.functions.columns import as_timestamp

# The query texts by topic and the five hot ones.
TOPIC_QUERIES = {
    "technology": [
        "machine learning tutorial", "python programming", "aws cloud services",
        "docker containers", "kubernetes deployment", "react javascript framework",
        "typescript best practices", "microservices architecture", "api design patterns",
        "database optimization",
    ],
    "education": [
        "online courses", "data science certification", "web development bootcamp",
        "computer science degree", "coding tutorials", "learn programming",
        "software engineering career", "tech interview preparation", "algorithm practice",
        "system design interview",
    ],
    "business": [
        "cloud cost optimization", "devops best practices", "agile methodology",
        "project management tools", "team collaboration software", "business intelligence",
        "data analytics platform", "enterprise architecture", "digital transformation",
        "it infrastructure",
    ],
    "tools": [
        "git version control", "jenkins ci cd", "terraform infrastructure",
        "ansible automation", "monitoring tools", "logging solutions",
        "testing frameworks", "code review tools", "ide plugins", "debugging tools",
    ],
}
HOT_QUERIES = [
    "machine learning tutorial",
    "python programming",
    "aws cloud services",
    "kubernetes deployment",
    "data science certification",
]
GENERATOR_SOURCE = "sample_data_generator"


def _draw(digest: Column, slot: int, bound: int) -> Column:
    """Uniform integer in [0, bound) from the slot-th 32-bit slice of a hex digest."""
    part = F.conv(F.substring(digest, slot * 8 + 1, 8), 16, 10).cast("long")
    return part % bound


def _pick(texts: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (index + 1).cast("int"))


def generate_log(ids: DataFrame, start, seed: int = 42, id_col: str = "id") -> DataFrame:
    """One search event per id, within the hour before ``start``.

    30 % of the events ask one of the hot queries, the rest any query evenly;
    users 1..10000, sessions 1..50000, results 0..500, and a click in 70 % of
    the events that had results.
    """
    every_query = [q for queries in TOPIC_QUERIES.values() for q in queries]
    rid = F.col(id_col).cast("string")
    one = F.md5(F.concat(F.lit(f"{seed}:a:"), rid))
    two = F.md5(F.concat(F.lit(f"{seed}:b:"), rid))
    drawn = ids.withColumns({"_a": one, "_b": two, "_start": as_timestamp(start)})
    a, b = F.col("_a"), F.col("_b")
    results = _draw(b, 1, 501)
    return drawn.select(
        F.col(id_col).alias("event_id"),
        (F.col("_start") - F.make_dt_interval(secs=_draw(b, 3, 3601).cast("decimal(18,6)"))).alias("timestamp"),
        F.concat(F.lit("user_"), _draw(a, 0, 10000) + 1).alias("user_id"),
        F.concat(F.lit("session_"), _draw(a, 1, 50000) + 1).alias("session_id"),
        F.when(_draw(a, 2, 1000) < 300, _pick(HOT_QUERIES, _draw(a, 3, len(HOT_QUERIES))))
        .otherwise(_pick(every_query, _draw(b, 0, len(every_query))))
        .alias("query"),
        results.cast("int").alias("results_count"),
        ((results > 0) & (_draw(b, 2, 1000) < 700)).alias("click_through"),
        F.lit(GENERATOR_SOURCE).alias("source"),
    )


def generate_batch(spark: SparkSession, count: int, start, seed: int = 42) -> DataFrame:
    return generate_log(spark.range(count), start, seed)


def generate_series(ids: DataFrame, end, per_hour: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Id blocks of ``per_hour`` become one hour each, going back from ``end``."""
    hours_back = F.make_dt_interval(hours=F.floor(F.col(id_col) / per_hour).cast("int"))
    return generate_log(ids, as_timestamp(end) - hours_back, seed, id_col)


def generate_time_series(spark: SparkSession, hours: int, per_hour: int, end, seed: int = 42) -> DataFrame:
    return generate_series(spark.range(hours * per_hour), end, per_hour, seed)
