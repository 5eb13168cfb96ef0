"""Distinct users over any range of days, and users that queries share, from one sketch per query-day.

The sketches are Theta sketches: they count exactly up to ``EXACT`` distinct users, beyond
that with a relative standard error of about ``1 / sqrt(EXACT)``; they merge over days and queries without
counting anyone twice, and intersect. Nothing returns to the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchpulse.functions.columns import as_date

#: Base-2 logarithm of a sketch's entries; it takes at most 8 bytes for each.
LOG_ENTRIES = 12
EXACT = 1 << LOG_ENTRIES
#: Three standard errors of a merged sketch that is full.
RELATIVE_ERROR = 3 / EXACT**0.5


def user_sketches(log: DataFrame) -> DataFrame:
    """One row per query and day: query_text, date, users (the sketch); null users count for nothing."""
    named = log.select("query_text", F.to_date("timestamp").alias("date"), "user_id")
    return named.groupBy("query_text", "date").agg(F.theta_sketch_agg("user_id", LOG_ENTRIES).alias("users"))


def users_between(sketches: DataFrame, first, last) -> DataFrame:
    """Per query its days and distinct users from ``first`` to ``last``: query_text, days, users (the sketch), n_users."""
    within = sketches.where(F.col("date").between(as_date(first), as_date(last)))
    merged = within.groupBy("query_text").agg(
        F.count_distinct("date").alias("days"), F.theta_union_agg("users", LOG_ENTRIES).alias("users")
    )
    return merged.withColumn("n_users", F.theta_sketch_estimate("users"))


def shared_users(merged: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each of the given (query_text, other_text) pairs: users of both and of either."""
    a = merged.select("query_text", F.col("users").alias("_a"))
    b = merged.select(F.col("query_text").alias("other_text"), F.col("users").alias("_b"))
    met = pairs.join(a, "query_text").join(b, "other_text")
    return met.select(
        "query_text",
        "other_text",
        F.theta_sketch_estimate(F.theta_intersection("_a", "_b")).alias("both"),
        F.theta_sketch_estimate(F.theta_union("_a", "_b", F.lit(LOG_ENTRIES))).alias("either"),
    )


def shared_users_exact(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each of the given (query_text, other_text) pairs of queries in the log: users of both and of either, exact.

    A sketch estimates beyond ``EXACT`` users; here the distinct users of the two queries are joined by user,
    so each shared user meets its other query once.
    """
    users = log.where(F.col("user_id").isNotNull()).select("query_text", "user_id").distinct()
    present = log.select("query_text").distinct()
    counted = present.join(users.groupBy("query_text").agg(F.count("*").alias("_n")), "query_text", "left")
    a = counted.select("query_text", F.coalesce("_n", F.lit(0)).alias("_a"))
    b = a.select(F.col("query_text").alias("other_text"), F.col("_a").alias("_b"))
    common = (
        pairs.join(users, "query_text")
        .join(users.select(F.col("query_text").alias("other_text"), "user_id"), ["other_text", "user_id"])
        .groupBy("query_text", "other_text")
        .agg(F.count("*").alias("_both"))
    )
    met = pairs.join(a, "query_text").join(b, "other_text").join(common, ["query_text", "other_text"], "left")
    both = F.coalesce("_both", F.lit(0))
    return met.select("query_text", "other_text", both.alias("both"), (F.col("_a") + F.col("_b") - both).alias("either"))
