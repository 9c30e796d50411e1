"""Per-key results without imbalance, by exact offset chunking.

Rows are range-partitioned by (key, order), so a key that holds a third of all rows is spread over a third of the
partitions. Each partition numbers its rows within each key, keys are counted per partition, and a prefix sum over the
counts gives the offset at which a key goes on in a later partition. Only the first key of a partition can have begun
earlier, so there are at most as many offsets as partitions. The row number of a key gives equal-sized chunks, which are
reduced one by one to a state; the states of a key are merged in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from sievework.shared import materialise

PART, LOCAL, ROW, CHUNK = "_part", "_local", "key_row", "key_chunk"


def _number(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and each row's place among the rows of its key there (from 1); rows come sorted."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, dtype=bool)
        for k in keys:
            column = batch.column(batch.schema.get_field_index(k))
            codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        first = tuple(batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys)
        new[0] = first != last
        starts = np.flatnonzero(new)
        local = np.arange(n, dtype=np.int64)
        base = np.full(n, -count, dtype=np.int64)
        if len(starts):
            base[starts[0] :] = np.repeat(starts, np.diff(np.append(starts, n)))
        local = local - base + 1
        last, count = tuple(batch.column(batch.schema.get_field_index(k))[n - 1].as_py() for k in keys), int(local[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(local)], names=[*batch.schema.names, PART, LOCAL])


def numbered_rows(df: DataFrame, keys: list[str], order_by: list[str], chunk_rows: int, partitions: int | None = None) -> DataFrame:
    """``df`` with ``key_row`` (1, 2, ... within each key, in the given order) and ``key_chunk`` (from 0, equal-sized).

    Rows that are equal in ``order_by`` come in no particular order among themselves, but each gets its own number; a
    null key is a key of its own. No row is dropped; input without rows gives no rows. The result is a written table in
    the shared folder, whose partitions are equal-sized whatever the distribution of keys. Columns of ``df`` that are named
    like the new ones come out with "_in" behind their names.
    """
    for name in (PART, LOCAL, ROW, CHUNK):
        if name in df.columns:
            free = f"{name}_in"
            while free in df.columns:
                free += "_in"
            df = df.withColumnRenamed(name, free)
            keys, order_by = ([free if c == name else c for c in names] for names in (keys, order_by))
    spark = df.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows that tie in the order are told apart, so that a key whose order is coarse is spread too
    tie = "_tie"
    while tie in df.columns:
        tie += "_"
    ordered = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(count, *keys, *order_by, tie).sortWithinPartitions(*keys, *order_by).drop(tie)
    schema = StructType([*df.schema.fields, StructField(PART, IntegerType()), StructField(LOCAL, LongType())])
    rows = materialise(ordered.mapInArrow(lambda batches: _number(batches, keys), schema), "keyed-rows")

    # prefix sums: a window over one key's partitions, of which there are at most as many as partitions exist
    counts = rows.groupBy(*keys, PART).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).where("_offset > 0").select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col(PART).alias("_o_part"), "_offset")
    same = [F.col(PART) == F.col("_o_part"), *[F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]]
    # at most one row per partition, hence a proven bound for the broadcast
    joined = rows.join(F.broadcast(offsets), same, "left")
    row = F.col(LOCAL) + F.coalesce(F.col("_offset"), F.lit(0))
    return joined.select(*df.columns, row.alias(ROW)).withColumn(CHUNK, F.expr(f"({ROW} - 1) div {int(chunk_rows)}"))


def heavy_keys(numbered: DataFrame, keys: list[str], total: int, share: float) -> DataFrame:
    """Keys whose last row number is at least ``share`` of ``total``; a null key is left out."""
    last = numbered.groupBy(*keys).agg(F.max(ROW).alias("n_rows"))
    for k in keys:
        last = last.where(F.col(k).isNotNull())
    return last.where(F.col("n_rows") >= F.lit(share) * F.lit(total))


def run_profile(numbered: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: rows, chunks, runs of equal ``value`` in row order, and the longest run; a null is a value of its own.

    Runs are found within the equal-sized chunks. Those inside a chunk are complete; the first and the last run of a chunk
    are its boundary states, and only these are walked in the order of the chunks, so that a run that crosses borders
    counts once. Nothing of a key is gathered in memory.
    """
    within = Window.partitionBy(*keys, CHUNK).orderBy(ROW)
    same = F.lag("_v").over(within).eqNullSafe(F.col("_v")) & (F.row_number().over(within) > 1)
    marked = numbered.select(*keys, CHUNK, ROW, F.col(value).alias("_v")).withColumn("_new", (~same).cast("long"))
    marked = marked.withColumn("_run", F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*keys, CHUNK, "_run").agg(F.count(F.lit(1)).alias("_len"), F.first("_v").alias("_v"))
    last = F.max("_run").over(Window.partitionBy(*keys, CHUNK))
    runs = materialise(runs.withColumn("_border", (F.col("_run") == 1) | (F.col("_run") == last)), "runs")

    walk = Window.partitionBy(*keys).orderBy(CHUNK, "_run")
    goes_on = (F.col("_run") == 1) & (F.row_number().over(walk) > 1) & F.lag("_v").over(walk).eqNullSafe(F.col("_v"))
    border = runs.where("_border").withColumn("_new", (~goes_on).cast("long")).withColumn("_island", F.sum("_new").over(walk.rowsBetween(Window.unboundedPreceding, 0)))
    joined = border.groupBy(*keys, "_island").agg(F.sum("_len").alias("_len"), F.max(CHUNK).alias(CHUNK))
    whole = joined.drop("_island").unionByName(runs.where("not _border").select(*keys, "_len", CHUNK))
    return whole.groupBy(*keys).agg(F.sum("_len").alias("n_rows"), (F.max(CHUNK) + 1).alias("n_chunks"), F.count(F.lit(1)).alias("n_runs"), F.max("_len").alias("longest_run"))
