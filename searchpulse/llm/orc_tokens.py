"""Token ids in ORC files, and reads that use the files' metadata.

Documents are ordered by id over all files, tokenised in the tasks that write, and
stored as (doc_id, start_in_file, n_tokens, ids): ORC run-length encodes the integers,
keeps an index of every ``row_stride`` rows in each stripe and Bloom filters on the
document ids. A reader takes stripes in parallel and skips those whose index or
filter rules the wanted ids out.

Edge cases: null and empty texts have the end id alone; a null id sorts first;
repeated ids keep all their rows, ordered by text; an empty table gives no rows;
texts of any length are one row; the order of files needs all rows of an id in one of them, so
an id that repeats very often fills one task; only the id and the text are read, so
other columns' names may clash.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchpulse.llm.tokens import END_ID, worker_encoder

STRIPE_BYTES = 32 << 20
ROW_STRIDE = 1000
ROWS_AT_ONCE = 2048


def write_tokens(
    docs: DataFrame,
    out: str,
    path: str,
    drops_blanks: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    stripe_bytes: int = STRIPE_BYTES,
    row_stride: int = ROW_STRIDE,
) -> None:
    """Tokenise every text and write the ids below ``out``, in order of the id.

    The texts are shuffled into ranges of ids, not their tokens, which are larger.
    """
    import pyarrow as pa

    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batches):
        import numpy as np

        encoder = worker_encoder(path, drops_blanks, end_id)
        place = 0
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), ROWS_AT_ONCE):
                part = encoder.encode(texts[at : at + ROWS_AT_ONCE].to_pylist())
                sizes = np.array([len(p) // 4 for p in part], np.int64)
                ends = np.cumsum(sizes)
                ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(part))])
                offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at : at + ROWS_AT_ONCE], pa.array(place + ends - sizes), pa.array(sizes), pa.ListArray.from_arrays(offsets, ids)],
                    ["doc_id", "start_in_file", "n_tokens", "ids"],
                )
                place += int(ends[-1])

    ordered = docs.select(id_col, text_col).repartitionByRange(id_col).sortWithinPartitions(id_col, text_col)
    rows = ordered.mapInArrow(encode, f"doc_id {id_type}, start_in_file long, n_tokens long, ids array<int>")
    (
        rows.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", row_stride)
        .option("compression", "zstd")
        .orc(out)
    )


def read_tokens(spark: SparkSession, out: str, id_type: str = "bigint", doc_ids: list | None = None) -> DataFrame:
    """Stored rows with the number of their file; with ``doc_ids`` only these, found through the files' metadata."""
    rows = spark.read.schema(f"doc_id {id_type}, start_in_file long, n_tokens long, ids array<int>").orc(out)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    return rows.select("*", number.alias("file_number"))


def token_digest(spark: SparkSession, out: str, id_type: str = "bigint") -> DataFrame:
    """doc_id, start among all ids, n_tokens and ids_crc32 of each stored document, from the files alone."""
    import pyarrow as pa

    def digest(batches):
        import numpy as np

        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64()), batch.column(3)],
                ["doc_id", "start_in_file", "n_tokens", "ids_crc32", "file_number"],
            )

    found = read_tokens(spark, out, id_type).select("doc_id", "start_in_file", "ids", "file_number")
    rows = found.mapInArrow(digest, f"doc_id {id_type}, start_in_file long, n_tokens long, ids_crc32 long, file_number long")
    # one row per file: the ids in all files before it
    sizes = read_tokens(spark, out, id_type).groupBy("file_number").agg(F.sum("n_tokens").alias("size"))
    before = sizes.selectExpr("file_number", "sum(size) OVER (ORDER BY file_number) - size AS before")
    joined = rows.join(before, "file_number")
    return joined.select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")
