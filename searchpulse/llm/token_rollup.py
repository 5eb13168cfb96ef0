"""Delta-maintained token counts by source, language and tokenizer version.

The rollup is a table of signed sums, one partition per committed batch; totals
are additive over the batches. A batch of changes becomes two signed rows a change
at most (what it adds, what it takes back), summed before it is written.

Committing the same batch again replaces its own partition, so repeats and retries
change nothing. Compaction folds all batches up to a horizon into one partition of
a new table; batches at or below the horizon are then refused as already counted.

Edge cases: null sources, languages or versions are keys of their own; null counts
are 0; repeated change rows in one batch each count, as the feed is the record of
what happened; an empty batch is committed as a batch without sums; groups whose
documents and tokens have both come back to 0 are left out of the totals; the feed holds counts,
not texts, so a very long text is one number; columns beyond those named are not read,
so their names may clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, kind string, batch_id long"


class BatchAlreadyFolded(ValueError):
    """The batch lies at or below the horizon of a compacted table."""


def signed_deltas(changes: DataFrame) -> DataFrame:
    """Signed sums per key.

    ``changes`` has op (insert, delete or revise), the keys and n_tokens of the
    state after, and old_<key> and old_n_tokens of the state before.
    """
    op = F.col("op")
    after = F.struct(*KEYS, F.lit(1).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    before = F.struct(
        *[F.col(f"old_{k}").alias(k) for k in KEYS],
        F.lit(-1).alias("n_docs"),
        (-F.coalesce("old_n_tokens", F.lit(0))).cast("long").alias("n_tokens"),
    )
    signed = F.array_compact(
        F.array(F.when(op.isin("insert", "revise"), after), F.when(op.isin("delete", "revise"), before))
    )
    rows = changes.select(F.explode(signed).alias("d")).select("d.*")
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def batches(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(root)


def horizon(spark: SparkSession, root: str) -> int | None:
    """The last batch folded by compaction, null without one."""
    return batches(spark, root).where("kind = 'base'").agg(F.max("batch_id")).head()[0]


def commit_batch(changes: DataFrame, root: str, batch_id: int, first: bool = False) -> None:
    """Write the batch's signed sums as its own partition, in place of an earlier try."""
    if not first and (folded := horizon(changes.sparkSession, root)) is not None and batch_id <= folded:
        raise BatchAlreadyFolded(f"batch {batch_id} is part of the totals up to {folded}")
    mark = changes.sparkSession.range(1).select(
        *[F.lit(None).cast("string").alias(k) for k in KEYS],
        F.lit(0).cast("long").alias("n_docs"),
        F.lit(0).cast("long").alias("n_tokens"),
        F.lit("mark").alias("kind"),
    )
    sums = signed_deltas(changes).withColumn("kind", F.lit("delta")).unionByName(mark)
    _write(sums.withColumn("batch_id", F.lit(batch_id).cast("long")), root)


def _write(rows: DataFrame, root: str) -> None:
    (
        rows.coalesce(1)  # sums of a batch: as many rows as keys
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(root)
    )


def totals(spark: SparkSession, root: str) -> DataFrame:
    """Current counts per source, language and tokenizer version."""
    sums = batches(spark, root).where("kind <> 'mark'").groupBy(*KEYS)
    return sums.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where(
        "n_docs <> 0 OR n_tokens <> 0"
    )


def compact(spark: SparkSession, root: str, new_root: str, upto: int) -> None:
    """Fold the batches up to ``upto`` into one partition of a new table; later ones are carried over."""
    old = batches(spark, root)
    base = old.where((F.col("batch_id") <= upto) & (F.col("kind") != "mark")).groupBy(*KEYS)
    base = base.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    base = base.withColumns({"kind": F.lit("base"), "batch_id": F.lit(upto).cast("long")})
    later = old.where(F.col("batch_id") > upto)
    _write(base.unionByName(later), new_root)
