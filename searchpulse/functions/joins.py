"""Join helper for keys that may be null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchpulse.session import ensure_checkpoint_dir


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, a null key matching a null key.

    Unlike an ordinary equi-join it adds no not-null filter to either side, so a
    side that is used elsewhere stays the same subplan and its shuffle is reused.
    """
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


BROADCAST_BYTES = 8 << 20


def counted_side(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` as the broadcast side of a join if its measured size allows it, else as it is.

    The rows are checkpointed, so they are computed once for the measurement and
    the join. Text counts with its bytes, any other column with sixteen.
    """
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint()
    width = [F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(16) for c, t in kept.dtypes]
    size = kept.agg(F.coalesce(F.sum(reduce(lambda a, b: a + b, width)), F.lit(0))).head()[0]
    return F.broadcast(kept) if size <= max_bytes else kept
